"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of one label are first put together, by a 128-bit digest that travels in their stead, so links are searched
between different vectors only. A vector's
signs on the hyperplanes of a table are its bucket there. Tables and hyperplanes follow from the number of vectors: as
many hyperplanes as keep buckets small, and as many tables as find a pair at the least similarity with probability RECALL.
Every two vectors of a bucket are compared; a bucket of more than BLOCK vectors is cut into blocks, and pairs of
blocks are tasks of their own, so no bucket is capped. A pair counts in the first table in which it meets, so no list of
pairs is needed: a task gives each vector's number of links, and a link to the root of its local component.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, and vectors without a label
link with nothing. Vectors of different lengths do not link. Repeated rows are vectors of their own and link with each
other. A row without an id counts as a partner, and names a component only if all its members lack ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm.common import ship, stored, table
from veil.llm.components import components

SIMILARITY, RECALL = 0.98, 0.9995
BUCKET, BLOCK, SEED = 16, 1024, 5


def usable(embedding: str = "embedding", label: str = "label") -> Column:
    """Whether a vector can link at all."""
    e = F.col(embedding).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.coalesce(~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes of a table and number of tables for `n` vectors of one label."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, n / BUCKET)))))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _codes(bits: int, tables: int):
    """(rid, codes) of every vector: its bucket in each table."""

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            codes = np.zeros((len(size), tables), np.int32)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                planes = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), bits * tables))
                signs = (_matrix(batch.column("embedding").take(pa.array(own))) @ planes > 0).reshape(len(own), tables, bits)
                codes[own] = signs @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int32()))], names=[*batch.schema.names, "codes"])

    return run


def _linked(similarity: float):
    """Links inside one pair of blocks: per vector its number of linked rows and the root of its local component."""
    schema = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key, group):
        group = group.combine_chunks()
        t, first, second = (key[i].as_py() for i in (3, 4, 5))
        rid, n, block = (group[c].to_numpy() for c in ("rid", "n", "block"))
        x = _matrix(group["embedding"].chunk(0))
        codes = _matrix(group["codes"].chunk(0))
        norm = np.sqrt((x * x).sum(axis=1))
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        cosine = x[a] @ x[b].T / (norm[a][:, None] * norm[b][None, :])
        i, j = np.nonzero(cosine >= similarity)
        i, j = a[i], b[j]
        fresh = i < j if first == second else np.ones(len(i), bool)
        i, j = i[fresh], j[fresh]
        met = np.zeros(len(i), bool)
        for s in range(t):
            met |= codes[i, s] == codes[j, s]
        i, j = i[~met], j[~met]
        links = np.bincount(i, n[j], len(rid)) + np.bincount(j, n[i], len(rid))
        root = np.arange(len(rid))
        while len(i):
            least = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], least)
            np.minimum.at(new, root[j], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        out = np.flatnonzero(links > 0)
        return pa.Table.from_arrays([pa.array(rid[out]), pa.array(links[out].astype(np.int64)), pa.array(rid[root[out]])], schema=schema)

    return run


def digest(embedding: str = "embedding") -> Column:
    """128 bits of a vector."""
    first, second = F.xxhash64(F.lit(1), embedding), F.xxhash64(F.lit(2), embedding)
    return F.concat_ws(":", first.cast("string"), second.cast("string"))


def representatives(vectors: DataFrame) -> DataFrame:
    """(rid, label, digest, embedding, size, n, least): one row for equal vectors of a label, with their number and least id."""
    same = vectors.where(usable()).withColumn("digest", digest()).groupBy("label", "digest")
    # equal vectors are put together before the shuffle, and one of them travels as a value, not as a key
    found = same.agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return stored(stored(found, "same").withColumn("rid", F.monotonically_increasing_id()).withColumn("size", F.size("embedding")), "representatives")


def linked(reps: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(rid, links, root) of each task in which a representative has links; links count rows, not representatives."""
    ship(reps.sparkSession)
    most = reps.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(most, similarity, recall)
    kind = "double" if reps.schema["embedding"].dataType.elementType.typeName() == "double" else "float"
    schema = f"rid long, label string, n long, size int, embedding array<{kind}>, codes array<int>"
    coded = reps.select("rid", F.col("label").cast("string").alias("label"), "n", "size", F.col("embedding").cast(f"array<{kind}>").alias("embedding")).mapInArrow(_codes(bits, tables), schema)
    coded = stored(coded, "coded")
    bucket = ["label", "size", "code", "t"]
    placed = coded.select("*", F.posexplode("codes").alias("t", "code"))
    sizes = coded.select("label", "size", F.posexplode("codes").alias("t", "code")).groupBy(*bucket).count().where("count > 1")
    sizes = stored(sizes.select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
    # a row goes to every pair of blocks that its own block is in
    met = placed.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    keys = [*bucket, "first", "second"]
    return met.select(*keys, "rid", "n", "block", "embedding", "codes").groupBy(*keys).applyInArrow(_linked(similarity), "rid long, links long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per vector: its number of links, the least id its component has, and whether it is kept."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    reps = representatives(rows)
    found = stored(linked(reps, similarity, recall), "links")
    named = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), reps.select(F.col("rid").alias("node"), "least"))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = (
        reps.join(counts, "rid", "left").join(named.withColumnRenamed("node", "rid"), "rid", "left")
        .select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    # vectors that cannot link have no digest, and no label or vector is needed here any more
    narrow = rows.select("vec_id", F.when(usable(), F.col("label")).alias("label"), F.when(usable(), digest()).alias("digest"))
    out = narrow.join(stored(known, "known"), ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
