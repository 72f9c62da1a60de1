r"""SimHash near-duplicates: fingerprints, links within a few bits by ball hashing, classes of linked documents.

Two fingerprints at most 4 bits apart have a value in between that is at most 2 bits from either. So every
distinct fingerprint stands for all its variants within 2 bits, variants are shuffled, and fingerprints that meet
on one variant are linked. The 2,081 variants of a fingerprint are shuffled in bundles: all variants that agree in
their leading bits travel as one row (prefix, fingerprint, flips still allowed behind the prefix), and the task that
owns the prefix spreads them out. A prefix that would hold too many variants is refined by more leading bits, as
often as needed; a prefix of all 64 bits holds each fingerprint once at most, so no bundle stays large.

Defined cases: a null or empty text and a text of spaces only have fingerprint 0 and link like any other. Fewer
than four words form one shingle. Repeated rows are rows of their own; a null doc_id takes part, and cannot name a
component unless all its members are null. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from veil.llm.common import ship, stored, table, texts, with_columns
from veil.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Variants that one bundle may hold before its prefix is refined, and by how many bits.
BUNDLE, STEP = 1 << 20, 6
BLOCK = 1 << 17
#: Ids (8 bytes each) that one broadcast may hold.
BROADCAST_IDS = 1 << 21


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text's word shingles as an unsigned number."""
    parts = text.lower().split()  # bytes: A-Z only, and spaces are \x20 and \x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts))
    ends, starts = ends[k - 1 :].tolist(), starts[: len(parts) - k + 1].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            yield batch, [np.array([fingerprint(t, words) for t in texts(batch, text)], np.uint64).view(np.int64)]

    return with_columns(docs, text, StructType([StructField(name, LongType(), False)]), run)


def ball(bits: int, flips: int) -> np.ndarray:
    """All masks with at most `flips` of the low `bits` bits set."""
    sets = (c for k in range(min(flips, bits) + 1) for c in combinations(range(bits), k))
    return np.array([sum(1 << b for b in c) for c in sets], np.uint64)


def _refined(bundles: DataFrame, depth: int, step: int, half: int) -> DataFrame:
    """Bundles whose prefix is `step` bits longer: the new bits are flipped in every way the bundle still allows."""
    masks = [(int(m), int(m).bit_count()) for m in ball(step, half)]
    rest = 64 - depth - step
    new_bits = F.shiftrightunsigned("fp", rest).bitwiseAND(F.lit((1 << step) - 1))
    variants = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(n).alias("used")) for m, n in masks))
    return (
        bundles.withColumn("v", F.explode(F.filter(variants, lambda v: v["used"] <= F.col("flips"))))
        .select(F.shiftleft("prefix", step).bitwiseOR(new_bits.bitwiseXOR(F.col("v.mask"))).alias("prefix"), "fp", (F.col("flips") - F.col("v.used")).alias("flips"))
    )


def _meeting(depth: int, half: int, radius: int):
    """Links between fingerprints that share a variant of one bundle."""
    masks = [ball(64 - depth, f) for f in range(half + 1)]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        fps, flips = group["fp"].to_numpy().view(np.uint64), group["flips"].to_numpy()
        order = np.argsort(flips, kind="stable")
        variants, owners = [], []
        for f in np.unique(flips):
            own = fps[order[np.searchsorted(flips[order], f) : np.searchsorted(flips[order], f, "right")]]
            variants.append((own[:, None] ^ masks[f][None, :]).ravel())
            owners.append(np.repeat(own, len(masks[f])))
        # the leading bits of a bundle's variants are equal; its fingerprints may differ there, so they are cut off
        variants = np.concatenate(variants) & np.uint64((1 << (64 - depth)) - 1)
        owners = np.concatenate(owners)
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        first = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
        size = np.diff(np.r_[first, len(variants)])
        shared = np.repeat(size > 1, size)
        owners, group_size = owners[shared], size[size > 1]
        if not len(owners):
            return schema.empty_table()
        if radius == 2 * half:
            # all fingerprints of one variant are within the radius of each other: links to the least are enough
            least = np.repeat(np.minimum.reduceat(owners, np.r_[0, np.cumsum(group_size)[:-1]]), group_size)
            pairs = np.stack([owners, least], axis=1)[owners != least]
        else:
            group, found = np.repeat(np.arange(len(group_size)), group_size), []
            for step in range(1, int(group_size.max())):
                one, other = owners[:-step], owners[step:]
                near = (group[:-step] == group[step:]) & (np.bitwise_count(one ^ other) <= radius)
                found.append(np.unique(np.stack([np.maximum(one, other)[near], np.minimum(one, other)[near]], axis=1), axis=0))
            pairs = np.concatenate(found)
        near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius
        pairs = np.unique(pairs[near], axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, i].view(np.int64)) for i in range(2)], schema=schema)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bundle: int = BUNDLE, step: int = STEP) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints `fp` at most `radius` bits apart, directly or through
    others that are as near to each other."""
    ship(distinct.sparkSession)
    half = (radius + 1) // 2
    weight = lambda depth: F.element_at(F.array(*(F.lit(len(ball(64 - depth, f))) for f in range(half + 1))), F.col("flips") + 1)
    expected = distinct.count() * len(ball(64, half))
    depth = min(60, max(step, int(np.ceil(np.log2(max(1, 4 * expected / bundle))))))
    bundles = _refined(distinct.select(F.lit(0).cast("long").alias("prefix"), "fp", F.lit(half).alias("flips")), 0, depth, half)
    found = []
    while True:
        if depth < 64:
            bundles = stored(bundles, "bundles")
            heavy = stored(bundles.groupBy("prefix").agg(F.sum(weight(depth)).alias("n")).where(F.col("n") > bundle).select("prefix"), "heavy")
            light = bundles.join(heavy, "prefix", "left_anti")
        else:
            heavy, light = None, bundles
        found.append(light.groupBy("prefix").applyInArrow(_meeting(depth, half, radius), "a long, b long"))
        if heavy is None or heavy.isEmpty():
            break
        more = min(step, 64 - depth)
        bundles, depth = _refined(bundles.join(heavy, "prefix", "left_semi"), depth, more, half), depth + more
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: its id, its fingerprint and the least id that links reach from it."""
    prints = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words, "fp").select("doc_id", "fp"), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    classes = components(stored(links(nodes.select("fp"), radius), "links"), nodes.withColumnRenamed("fp", "node"))
    classes = nodes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component one row, of the least id.

    Components hold fingerprints, so rows that repeat an id with other texts are told apart. Documents without an id
    all stay. Ids of documents that go are broadcast up to BROADCAST_IDS of them, so that texts are not shuffled;
    beyond that the join shuffles.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    prints = stored(fingerprints(named.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", WORDS, "fp").select("doc_id", "fp"), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(stored(links(nodes.select("fp")), "links"), nodes.select(F.col("fp").alias("node"), F.col("fp").alias("least")))
    groups = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("__group"))
    leaders = groups.groupBy("__group").agg(F.min("least").alias("__leader"))
    groups = stored(groups.join(leaders, "__group").select(F.col("fp").alias("__fp"), "__group", "__leader"), "groups")
    leads = F.max(F.col("doc_id") == F.col("__leader")).alias("leads")
    ids = stored(prints.join(groups, F.col("fp") == F.col("__fp")).groupBy("doc_id").agg(leads, F.count(F.lit(1)).alias("n")), "classes")
    gone = ids.where("NOT leads OR n > 1").select(F.col("doc_id").alias("__id"))
    repeated = stored(ids.where("leads AND n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs[doc_id] == F.col("__id"), "left_anti")
    if repeated.isEmpty():
        return kept
    # rows of ids that repeat get a written key, as ids do not tell them apart
    rows = fingerprints(docs.join(repeated, docs[doc_id] == F.col("__id"), "left_semi"), text, WORDS, "__print")
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    own = rows.select("__row", "__print", F.col(doc_id).alias("__id")).join(groups, F.col("__print") == F.col("__fp")).where("__id = __leader")
    chosen = own.groupBy("__group").agg(F.min("__row").alias("__row")).select("__row")
    return kept.unionByName(rows.join(chosen, "__row", "left_semi").drop("__print", "__row"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
