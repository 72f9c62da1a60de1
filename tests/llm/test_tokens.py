import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veil.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "", " ", "a", "'s", "'ll re", "don't 'st ''s 's's", "aaaaaaaaaaaa" * 50, "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext|>y",
    "a " * 3000, "\n\n\nx  y \n z   ", "￿ a￿", " '", "' s", "I'VE I've'll", "\x00\x01", "x" * 20_000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def cases():
    rng, letters = random.Random(1), "abcdst'' \n\t  '’ é漢字🙂０Ⅷ½12!?.,-_= cLlReveMm’dñ\xa0 "
    return TRICKY + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)]


def test_counts_equal_the_library(vocabulary, cases):
    expected = [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(cases, add_special_tokens=False)]
    assert bpe.count(vocabulary, cases).tolist() == expected


def test_ids_equal_the_library(vocabulary, cases):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    got = bpe.encode(vocabulary, cases)
    for text, ids, e in zip(cases, got, library.encode_batch(cases, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u2").tolist() == e.ids, repr(text)


def test_full_memory_changes_nothing(vocabulary, cases, monkeypatch):
    expected = bpe.count(vocabulary, cases)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "CHUNK", 500)
    bpe._memories.clear()
    assert (bpe.count(vocabulary, cases) == expected).all()


def test_awkward_rows(awkward):
    out = tokens.token_counts(awkward, PATH, name="n")
    rows = out.collect()
    assert len(rows) == awkward.count() and out.columns == [*awkward.columns, "n"]
    assert {r.doc_id: r.n for r in rows if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert tokens.token_counts(awkward, PATH).columns[-1] == "_n_tokens"
    assert tokens.token_counts(awkward.limit(0), PATH).count() == 0


def test_query_over_the_tables_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in tokens.op8_token_counts(spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
