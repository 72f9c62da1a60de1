import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veil.functions.lineage import scratch_path
from veil.llm import output

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_one_and_has_an_inverse(n):
    p, every = output.Permutation(n), np.arange(n)
    slots = p.slot(every)
    assert sorted(slots) == list(range(n)) and (p.sequence(slots) == every).all()
    assert n < 10 or (output.Permutation(n, key=1).slot(every) != slots).any()


def joined(spark, path, length, slots, n):
    """Ids of all sequences in their order before the permutation."""
    rows = output.sequences_from(spark, path, 0, length, slots).collect()
    order = output.Permutation(max(1, n))
    by = {int(order.sequence(np.array([r.slot]))[0]): bytes(r.ids) for r in rows}
    assert len(by) == n and all(len(x) == 2 * length for x in by.values())
    return np.frombuffer(b"".join(by[i] for i in range(n)), "<u2")


@pytest.mark.parametrize("length,slots", [(16, 4), (64, 1000)])
def test_round_trip(spark, documents, length, slots):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    texts = ["hello world <|endoftext|>\n", "", None, "a b c " * 100, "é漢字", "same", "same"]
    docs = documents([(i if i else None, t, None, None) for i, t in enumerate(texts)]).repartition(3)
    path = scratch_path(spark, "shards")
    index = output.write_shards(docs, PATH, path, length, slots).orderBy("slot").collect()
    ids = joined(spark, path, length, slots, len(index))
    ends = np.flatnonzero(ids == output.END)
    total = sum(r.n_tokens for r in index)
    found = [ids[a + 1 : b].tolist() for a, b in zip(np.r_[-1, ends[:-1]], ends) if b < total]
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted(found) == sorted(expected) and (ids[total:] == output.END).all()
    assert [r.slot for r in index] == list(range(len(index)))
    assert all((r.shard, r.offset) == (r.slot // slots, r.slot % slots * (2 * length + 1)) for r in index)


def test_reading_resumes_at_a_slot(spark, documents):
    docs = documents([(i, f"document number {i} " * 9, None, None) for i in range(40)])
    path = scratch_path(spark, "shards")
    n = output.write_shards(docs, PATH, path, 16, 4).count()
    every = {r.slot: bytes(r.ids) for r in output.sequences_from(spark, path, 0, 16, 4).collect()}
    rest = {r.slot: bytes(r.ids) for r in output.sequences_from(spark, path, 13, 16, 4).collect()}
    assert len(every) == n and rest == {s: x for s, x in every.items() if s >= 13}


def test_awkward_rows(spark, awkward):
    rows = output.written(spark, awkward, PATH, 256, 8).collect()
    assert sum(r.doc_ids.count(4) for r in rows) == 2 and sum(len(r.doc_ids) - len(set(r.doc_ids)) for r in rows) >= 1
    assert output.written(spark, awkward.limit(0), PATH).count() == 0


def test_query_covers_every_token(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = output.op9_token_output(spark, sf_dir).collect()
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in docs.values())
    assert sum(r.n_tokens for r in rows) == total and len(rows) == -(-total // output.LENGTH)
    assert {d for r in rows for d in r.doc_ids} == set(docs)
    assert len({r.sha256 for r in rows}) > 1 and all(len(r.sha256) == len(hashlib.sha256().hexdigest()) for r in rows)


def test_pieces_of_a_batch_that_is_part_of_another():
    """Ids are cut by the places of the batch's own rows, for the wave's slots only; null-free or empty, whole or sliced."""
    import pyarrow as pa

    lengths, length = [3, 1, 40, 7, 25, 2], 8
    ids = [np.arange(n, dtype="<u2") + 100 * i for i, n in enumerate(lengths)]
    at = np.cumsum([0, *lengths[:-1]])
    names = ["doc_id", "n", "ids", "at"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lengths), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(at)], names=names)
    order = output.Permutation(-(-sum(lengths) // length))
    for begin, end in ((0, 4), (4, order.n), (0, order.n)):
        for first, rows in ((0, 6), (2, 3), (5, 1), (6, 0)):
            (found,) = output._pieces(order, length, 2, begin, end)([whole.slice(first, rows)])
            expected = []
            for i in range(first, first + rows):
                for k in range(at[i] // length, (at[i] + lengths[i] - 1) // length + 1):
                    slot, a, b = int(order.slot(np.array([k]))[0]), max(at[i], k * length) - at[i], min(at[i] + lengths[i], (k + 1) * length) - at[i]
                    if begin <= slot < end:
                        expected.append((slot, i, ids[i][a:b].tobytes()))
            assert list(zip(*(found.column(c).to_pylist() for c in ("slot", "doc_id", "ids")))) == expected


def test_a_known_pretoken_is_looked_up_and_not_merged_again(monkeypatch):
    from veil.llm import bpe

    vocabulary = bpe.load(PATH)
    first = bpe.encode(vocabulary, ["some words and some more words"])
    monkeypatch.setattr(bpe, "merge", lambda *_: pytest.fail("merged again"))
    assert bpe.encode(vocabulary, ["some words and some more words"]) == first
    assert bpe.REMEMBERED <= 1 << 18  # two workers of an executor keep this many each, beside all else
