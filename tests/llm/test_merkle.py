import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from veil.llm import merkle

NAMES = merkle.COLUMNS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in NAMES))


def up(nodes):
    return [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]


def path(nodes, i):
    """Top node, and the siblings of node i on its way there."""
    out = []
    while len(nodes) > 1:
        first = i - i % 3
        out.append((i % 3, [nodes[k] for k in range(first, min(len(nodes), first + 3)) if k != i]))
        nodes, i = up(nodes), i // 3
    return nodes[0], out


def expected(rows):
    """The contract, in memory: {(doc_id, leaf): the other columns}."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    lower = {s: [leaf(r) for r in groups[s]] for s in order}
    tops = [path(lower[s], 0)[0] for s in order]
    out = []
    for t, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            root, above = path(tops, t)
            steps = path(lower[s], i)[1] + above
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                changed["text"] = r["text"].replace("\n", "")
            folded = leaf(changed)
            for slot, others in steps:
                folded = H(*others[:slot], folded, *others[slot:])
            out.append((r["doc_id"], leaf(r), tops[t], root, H(*(d for _, o in steps for d in o)), folded, folded == root))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query_over_the_tables(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = result(merkle.op11_merkle_manifest(spark, sf_dir))
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


def test_query_equals_its_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), merkle.op11_merkle_manifest, merkle.ORACLE, sf_dir) == ""


@pytest.mark.parametrize("levels", [1, 2])
def test_hot_source_in_many_blocks(documents, levels):
    rows = [(i, f"x\n{i}", None, "hot") for i in range(200)] + [(i, "y", "en", f"s{i}") for i in range(200, 230)] + [(230, None), (231, "", None, "")]
    docs = documents(rows)
    assert result(merkle.audited(docs, levels)) == expected([r.asDict() for r in docs.collect()])


def test_awkward_rows(awkward):
    docs = awkward.drop("label")
    rows = [r.asDict() for r in docs.select(*NAMES).collect()]
    assert result(merkle.audited(docs)) == expected(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_few_rows(documents, n):
    docs = documents([(i, "a\nb", None, "s") for i in range(n)])
    assert result(merkle.audited(docs)) == expected([r.asDict() for r in docs.collect()])


def test_multiproof_is_least_and_proves_a_subset(documents):
    docs = documents([(i, f"t{i}", None, "a" if i % 3 else "b") for i in range(90)])
    m = merkle.manifest(docs, NAMES, carry=["lang"], levels=3)
    some = m.leaves.where("id % 7 = 0")
    shown = merkle.proofs(m, some)
    checked = shown.select("id", (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), "root").collect()
    assert len(checked) == 13 and all(r.ok and r.root == m.root for r in checked)
    # nothing is fetched that is held or can be derived
    assert [(level, idx.tolist()) for level, idx in merkle.missing([10, 4, 2, 1], merkle.np.array([0, 1, 4, 9]))] == [(0, [2, 3, 5]), (1, [2]), (2, [])]


def test_clashing_names(documents):
    docs = documents([(1, "a", None, "s"), (2, "b", None, "s")]).withColumn("proof", F.lit(7)).withColumn("root", F.lit("r"))
    out = merkle.proofs(merkle.manifest(docs, NAMES, carry=["proof", "root"]))
    assert out.columns == ["id", "leaf", "proof", "root", "subroot", "_root", "_proof"]
    assert {r.proof for r in out.collect()} == {7}
