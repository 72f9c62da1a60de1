r"""Merkle manifest of a table, with multiproofs by the octopus method.

Every row is a leaf. The leaves of a source, in the order of their ids, are folded in runs of three until one node is
left; the nodes so left of all sources, in the order of the sources, are folded likewise to the root. What is kept is a
narrow table of leaves and one of inner nodes, each node under its coordinate (tree, level, place).

A proof is made by partition, not by leaf: a partition of leaves finds level by level which siblings it neither holds nor
can derive (the least such set), all partitions fetch theirs in one join with the nodes, derive what their leaves share,
and expand a proof for each leaf on the spot. A proof holds, level by level up to the root, the place of the node in
its run and the digests of the others; `folded` recomputes the root from it in plain column expressions.

Trees are built the same way: blocks of 3^7 neighbouring leaves fold seven levels in a task, then blocks of the nodes
that are left. A source that holds most rows is many blocks; places are found inside ranges (`places`).

Defined cases: the digest of a row names null cells apart from empty ones. A null id comes first in its source, rows of
one id follow the order of their digests, a null source is a source of its own and comes first. A source of one row is
its own top node. Repeated rows are leaves each. No rows have no root and no proofs. Columns called like one that is
added keep their name, and the added one gets an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from veil.llm.common import free_name, ship, stored, table
from veil.llm.places import numbered

FANOUT = 3
#: Levels that one task folds: a block has FANOUT ** LEVELS leaves.
LEVELS = 7
#: The tree over the top nodes of the sources.
TOP = -1
NODE = "tree long, level int, idx long, digest string, n long"
PROOF = "array<struct<slot: int, siblings: array<string>>>"


def H(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sizes(n: int) -> list[int]:
    """Nodes of each level above n leaves, up to the single one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of the cells of a row: each `-` if null, else its length in bytes, a colon and its text."""
    cells = []
    for c in columns:
        text = c.cast("string")
        cells.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*cells).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """`leaves` (tree, pos, n, leaf, carried columns), `nodes` of all trees, `trees` (tree, source, n, subroot), the root, the number of trees and the levels of a block."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    n_trees: int
    levels: int


def _fold_block(levels: int):
    """All nodes up to `levels` above a block of neighbouring nodes."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("idx")
        tree, level, n = (block.column(c)[0].as_py() for c in ("tree", "level", "n"))
        first, digests = block.column("idx")[0].as_py(), block.column("digest").to_pylist()
        out = [[], [], [], []]
        for _ in range(levels):
            if n == 1:
                break
            digests = [H(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
            first, level, n = first // FANOUT, level + 1, -(-n // FANOUT)
            for column, values in zip(out, ([level] * len(digests), range(first, first + len(digests)), digests, [n] * len(digests))):
                column.extend(values)
        arrays = [pa.array([tree] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())]
        return pa.Table.from_arrays(arrays, names=["tree", "level", "idx", "digest", "n"])

    return run


def inner_nodes(base: DataFrame, largest: int, levels: int = LEVELS) -> DataFrame | None:
    """Inner nodes of trees given by their leaves (as nodes of level 0), of which the largest has `largest` leaves."""
    built, level = None, 0
    while largest > 1:
        block = F.expr(f"idx div {FANOUT**levels}").alias("block")
        step = stored(base.where("n > 1").groupBy("tree", block).applyInArrow(_fold_block(levels), NODE), "nodes")
        built = step if built is None else built.union(step)
        level, largest = level + levels, -(-largest // FANOUT**levels)
        base = step.where(F.col("level") == level)
    return built


def manifest(docs: DataFrame, columns: Sequence[str], id_: str = "doc_id", source: str = "source", carry: Sequence[str] = (), levels: int = LEVELS) -> Manifest:
    """The trees over `docs`. A leaf is the digest of `columns`; `carry` are further columns to keep with the leaves."""
    ship(docs.sparkSession)
    digest = leaf_digest([F.col(c) for c in columns]).alias("leaf")
    narrow = stored(docs.select(F.col(id_).alias("id"), F.col(source).alias("source"), digest, *carry), "leaves")
    sources = stored(narrow.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "sources")
    trees = stored(numbered(sources, [], ["source"], "sources").select(F.col("pos").alias("tree"), "source", "n"), "trees")
    placed = numbered(narrow, ["source"], ["id", "leaf"], "ranges", trees.drop("n"))
    leaves = stored(placed.withColumnRenamed("group_size", "n").drop("source"), "placed")
    base = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"), "n")
    n_trees, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    inner = inner_nodes(base, largest or 0, levels)
    nodes = base if inner is None else base.union(inner)
    # a node that stands alone on its level; of a tree of one leaf, the leaf
    tops = nodes.where("n = 1").select("tree", F.col("digest").alias("subroot"))
    trees = stored(trees.join(tops, "tree"), "subroots")
    upper = trees.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(n_trees).cast("long").alias("n"))
    above = inner_nodes(upper, n_trees, levels)
    nodes = nodes.union(upper) if above is None else nodes.union(upper).union(above)
    root = nodes.where(f"tree = {TOP} and n = 1").select("digest").first()  # one row
    return Manifest(leaves, nodes, trees, root and root[0], n_trees, levels)


def missing(counts: Sequence[int], idx: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per level, the least set of places that must be fetched to fold the leaves at `idx` up to the single node."""
    out, known = [], np.unique(idx)
    for level, n in enumerate(counts[:-1]):
        parents = np.unique(known // FANOUT)
        run = (parents[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        out.append((level, np.setdiff1d(run[run < n], known, assume_unique=True)))
        known = parents
    return out


def _wanted(n_trees: int):
    def run(block: pa.Table) -> pa.Table:
        tree, n, number = (block.column(c)[0].as_py() for c in ("tree", "n", "block"))
        found = [(tree, *m) for m in missing(sizes(n), block.column("pos").to_numpy())]
        found += [(TOP, *m) for m in missing(sizes(n_trees), np.array([tree]))]
        rows = [(at, level, i) for at, level, idx in found for i in idx.tolist()]
        at, level, idx = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        arrays = [pa.array([tree] * len(rows), pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array(at, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())]
        return pa.Table.from_arrays(arrays, names=["tree", "block", "at", "level", "idx"])

    return run


def _derived(counts: Sequence[int], known: list[dict[int, str]]) -> str:
    """Adds to `known`, a dict per level, all nodes that follow from it; gives the top one."""
    for level, n in enumerate(counts[:-1]):
        here, above = known[level], known[level + 1]
        for p in {i // FANOUT for i in here}:
            if p not in above:
                run = [here.get(i) for i in range(p * FANOUT, min(n, (p + 1) * FANOUT))]
                if None not in run:
                    above[p] = H(run)
    return known[-1][0]


def _expand(n_trees: int, names: tuple[str, str, str], schema: pa.Schema):
    """Proofs of the leaves of a block from the nodes fetched for it."""
    upper = sizes(n_trees)

    def run(rows: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, n = (rows.column(c)[0].as_py() for c in ("tree", "n"))
        lower = sizes(n)
        known, top = ([{} for _ in s] for s in (lower, upper))
        pos = rows.column("pos").to_numpy()
        known[0].update(zip(pos.tolist(), rows.column("leaf").to_pylist()))
        for at, level, idx, digest in zip(*(fetched.column(c).to_pylist() for c in ("at", "level", "idx", "digest"))):
            (top if at == TOP else known)[level][idx] = digest
        top[0][tree] = subroot = _derived(lower, known)
        root = _derived(upper, top)

        others = []  # per level of the way up: place of each leaf's node, and the digests beside each node
        for counts, have, place in ((lower, known, pos), (upper, top, np.full(len(pos), tree))):
            for level, size in enumerate(counts[:-1]):
                places, which = np.unique(place, return_inverse=True)
                beside = [[have[level][k] for k in range(i - i % FANOUT, min(size, i - i % FANOUT + FANOUT)) if k != i] for i in places.tolist()]
                others.append((place % FANOUT, which.tolist(), beside))
                place = place // FANOUT
        height, count = len(others), len(pos)
        lists = [beside[w] for row in zip(*(which for _, which, _ in others)) for w, (_, _, beside) in zip(row, others)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
        siblings = pa.ListArray.from_arrays(pa.array(ends), pa.array([d for x in lists for d in x], pa.string()))
        slot = np.stack([s for s, _, _ in others], 1).ravel() if others else np.zeros(0)
        steps = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), siblings], names=["slot", "siblings"])
        proof = pa.ListArray.from_arrays(pa.array((np.arange(count + 1) * height).astype(np.int32)), steps)
        added = [pa.array([subroot] * count), pa.array([root] * count), proof]
        kept = [c for c in rows.column_names if c not in ("tree", "pos", "n", "block")]
        out = pa.Table.from_arrays([*(rows.column(c).combine_chunks() for c in kept), *added], names=[*kept, *names])
        return out.select(schema.names).cast(schema)

    return run


def proofs(m: Manifest, rows: DataFrame | None = None) -> DataFrame:
    """`rows`, any of the manifest's leaves (default: all), with `subroot`, `root` and `proof`."""
    rows = m.leaves if rows is None else rows
    rows = rows.withColumn("block", F.expr(f"pos div {FANOUT**m.levels}"))
    ship(rows.sparkSession)
    wanted = rows.select("tree", "block", "pos", "n").groupBy("tree", "block").applyInArrow(_wanted(m.n_trees), "tree long, block long, at long, level int, idx long")
    places = m.nodes.select(F.col("tree").alias("at"), "level", "idx", "digest")
    fetched = wanted.join(places, ["at", "level", "idx"])
    names = tuple(free_name(rows, c) for c in ("subroot", "root", "proof"))
    kept = [f for f in rows.schema.fields if f.name not in ("tree", "pos", "n", "block")]
    proof = StructType.fromDDL(f"proof {PROOF}").fields[0].dataType
    schema = StructType([*kept, StructField(names[0], StringType()), StructField(names[1], StringType()), StructField(names[2], proof)])
    pairs = rows.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block"))
    return pairs.applyInArrow(_expand(m.n_trees, names, to_arrow_schema(schema)), schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and a proof."""

    def step(digest: Column, s: Column) -> Column:
        before, after = F.slice(s["siblings"], 1, s["slot"]), F.slice(s["siblings"], s["slot"] + 1, FANOUT)
        return F.sha2(F.concat(F.array_join(before, ""), digest, F.array_join(after, "")).cast("binary"), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "").cast("binary"), 256)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def audited(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves of all documents with their proofs; those that crc32 picks are tampered with, and are to fail."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    candidate = leaf_digest([text if c == "text" else F.col(c) for c in COLUMNS])
    m = manifest(docs.withColumn("candidate", candidate), COLUMNS, carry=["candidate"], levels=levels)
    shown = proofs(m).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        folded(F.col("candidate"), F.col("proof")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`audited` over all documents."""
    return audited(table(spark, sf_dir, "documents", *COLUMNS))


def _cell(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


#: crc32 of the decimal id, eight steps a digit: the first of them takes the digit in.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
     lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, c: xor(xor(s, c) >> 1, CASE WHEN xor(s, c) % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
_CELLS = " || ".join(_cell(c) for c in COLUMNS)
_CHANGED = " || ".join(_cell("changed" if c == "text" else c) for c in COLUMNS)
ORACLE = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
l AS (SELECT doc_id, source, sha256({_CELLS}) AS h, sha256({_CHANGED}) AS c FROM d),
p AS (SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
low AS (SELECT source, 0 AS level, pos AS idx, h, n FROM p
  UNION ALL SELECT source, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY source, level, idx // 3),
t AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (SELECT 0 AS level, tree AS idx, h, n FROM t
  UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, idx // 3),
q AS (SELECT p.*, t.tree, t.h AS subroot FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
s AS (SELECT r, level, idx, low.h FROM q JOIN low ON q.source IS NOT DISTINCT FROM low.source AND low.n > 1
   AND low.idx // 3 = q.pos // CAST(pow(3, level + 1) AS BIGINT) AND low.idx <> q.pos // CAST(pow(3, level) AS BIGINT)
  UNION ALL SELECT r, 1000 + level, idx, top.h FROM q JOIN top ON top.n > 1
   AND top.idx // 3 = q.tree // CAST(pow(3, level + 1) AS BIGINT) AND top.idx <> q.tree // CAST(pow(3, level) AS BIGINT)),
proof AS (SELECT r, string_agg(h, '' ORDER BY level, idx) AS x FROM s GROUP BY r),
f AS (SELECT r, source, 0 AS level, pos AS idx, c AS h, n FROM q
  UNION ALL SELECT r, any_value(f.source), any_value(f.level + 1), any_value(f.idx // 3), sha256(string_agg(CASE WHEN low.idx = f.idx THEN f.h ELSE low.h END, '' ORDER BY low.idx)), any_value((f.n + 2) // 3)
   FROM f JOIN low ON f.n > 1 AND f.source IS NOT DISTINCT FROM low.source AND f.level = low.level AND low.idx // 3 = f.idx // 3 GROUP BY r),
g AS (SELECT q.r, 0 AS level, q.tree AS idx, f.h, (SELECT count(*) FROM t) AS n FROM f JOIN q ON f.r = q.r WHERE f.n = 1
  UNION ALL SELECT r, any_value(g.level + 1), any_value(g.idx // 3), sha256(string_agg(CASE WHEN top.idx = g.idx THEN g.h ELSE top.h END, '' ORDER BY top.idx)), any_value((g.n + 2) // 3)
   FROM g JOIN top ON g.n > 1 AND g.level = top.level AND top.idx // 3 = g.idx // 3 GROUP BY r)
SELECT q.doc_id, q.h AS leaf, q.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(proof.x, '')) AS proof_sha256,
  g.h AS folded_root, g.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM q JOIN g ON q.r = g.r AND g.n = 1 LEFT JOIN proof ON q.r = proof.r
"""
