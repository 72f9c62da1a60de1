r"""Training-order output: token ids in fixed-stride shards, in a keyed random order that needs no sorting key.

Documents become token ids, each closed by an end token, and their concatenation is cut into sequences of one length.
A keyed Feistel network permutes the sequence numbers; numbers that leave the range walk its cycle until they are back,
so every sequence has one global slot and every slot one sequence. The shard of a slot is its quotient by the slots of
a shard, which is the partition that writes it: one file a shard, a record of fixed stride for each slot. A reader at
slot s opens shard s // slots at byte (s % slots) * stride and reads on.

Shards are written in waves, each a range of slots with a folder and a shuffle of its own, whose files go when it ends:
so little of the shuffle is on disk at once, and a job that broke off need only repeat the waves it has not written.

Shards are written by Spark's text sink, which commits whole tasks, so a record ends with a line feed that belongs to
its stride. Ids are 16-bit little-endian numbers; the last sequence is filled up with end tokens.

Defined cases: a null or empty text is one end token. Repeated rows are written as often as they come. No documents
give no sequence. A null doc_id stays null in the lists of documents.
"""

from __future__ import annotations

import public_tokenizers
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.functions.lineage import scratch_path
from veil.llm.bpe import encode, load
from veil.llm.common import ship, shuffles_dropped, slices, stored, table, texts

VOCABULARY, END = "byte_bpe_50k.json", 50256
LENGTH, SLOTS, KEY, ROUNDS, WAVES = 1024, 1 << 12, 20240229, 6, 4


class Permutation:
    """Keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, rounds).astype(np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ x >> np.uint64(32)) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ self._mixed(right, k)
        return right << self.half | left

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self.keys)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        """The inverse of `slot`: the same network with its keys reversed, its halves swapped before and after."""
        return self._walk(slot, self.keys[::-1])


def tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """(part, start, n, doc_id, ids): ids of each document with its end token, placed in the row of its partition's ids.

    Written once: the places hold whatever order a partition is read in, and later steps read them from the table.
    """
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    closing = int(end).to_bytes(2, "little")

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids = [x + closing for x in encode(vocabulary.value, [t.decode("utf-8", "replace") for t in texts(batch, "text")])]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            arrays = [pa.array(np.full(len(ids), part, np.int32)), pa.array(start), pa.array(n), batch.column(0), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = chosen.mapInArrow(run, "part int, start long, n long, doc_id long, ids binary")
    path = scratch_path(docs.sparkSession, "tokens")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def placed(table_: DataFrame) -> tuple[DataFrame, int]:
    """Tokens with their place `at` among all tokens, and the number of all tokens."""
    sums = table_.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = stored(sums.select("part", "total", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    total = bases.agg(F.sum("total")).first()[0] or 0
    return table_.join(bases.select("part", "base"), "part").withColumn("at", F.col("base") + F.col("start")).drop("part", "start", "base"), total


def _pieces(permutation: Permutation, length: int, slots: int, begin_slot: int = 0, end_slot: int | None = None, with_ids: bool = True):
    """Cuts documents at the borders of sequences, for a range of slots: (shard, slot, at, n, doc_id[, ids]); shards count from its first."""

    def run(batches):
        for batch in batches:
            at, n = (batch.column(c).to_numpy() for c in ("at", "n"))
            first, last = at // length, (at + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(at)), count)
            sequence = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            slot = permutation.slot(sequence)
            own = (slot >= begin_slot) & (slot < (permutation.n if end_slot is None else end_slot))
            row, sequence, slot = row[own], sequence[own], slot[own]
            begin, end = np.maximum(at[row], sequence * length), np.minimum(at[row] + n[row], (sequence + 1) * length)
            arrays = [pa.array(((slot - begin_slot) // slots).astype(np.int32)), pa.array(slot), pa.array(begin - sequence * length), pa.array(end - begin), batch.column("doc_id").take(pa.array(row))]
            names = ["shard", "slot", "at", "n", "doc_id"]
            if with_ids:
                # cut out of the batch itself: of most documents a wave takes nothing
                ids = batch.column("ids").cast(pa.large_binary())
                _, places, content = ids.buffers()
                place = np.frombuffer(places, np.int64)[ids.offset + row]
                a, b = (place + (x - at[row]) * 2 for x in (begin, end))
                data = memoryview(content) if content else b""
                arrays.append(pa.array([bytes(data[i:j]) for i, j in zip(a.tolist(), b.tolist())], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


PIECE = "shard int, slot long, at long, n long, doc_id long"


def _records(length: int, end: int):
    """Puts the sorted pieces of a shard together: one record a slot."""
    filler = int(end).to_bytes(2, "little") * length

    def run(batches):
        slot, parts = None, []
        for batch in batches:
            out = []
            for s, ids in zip(batch.column("slot").to_pylist(), batch.column("ids").to_pylist()):
                if s != slot:
                    if parts:
                        out.append((b"".join(parts) + filler)[: 2 * length])
                    slot, parts = s, []
                parts.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([(b"".join(parts) + filler)[: 2 * length]], pa.binary())], names=["record"])

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY, doc_id: str = "doc_id", text: str = "text", end: int = END, waves: int = WAVES) -> DataFrame:
    """Writes the shards below `path`, each wave in a folder named by its first shard, and returns their index: slot, shard, byte offset, number of tokens that are not
    filling, and the ids of the documents in the sequence, in its order."""
    spark = docs.sparkSession
    all_tokens, total = placed(tokens(docs, tokenizer, doc_id, text, end))
    count = -(-total // length)
    shards = max(1, -(-count // slots))
    order = Permutation(max(1, count), key)
    per_wave = -(-shards // waves)
    for wave in range(-(-shards // per_wave)):
        begin = wave * per_wave * slots
        stop = min(count, begin + per_wave * slots)
        pieces = all_tokens.mapInArrow(_pieces(order, length, slots, begin, stop), f"{PIECE}, ids binary")
        sorted_ = pieces.repartitionById(max(1, -(-(stop - begin) // slots)), F.col("shard")).sortWithinPartitions("slot", "at").select("slot", "ids")
        with shuffles_dropped(spark):
            sorted_.mapInArrow(_records(length, end), "record binary").select(F.col("record").cast("string").alias("value")).write.text(f"{path}/{begin // slots:09d}")
    index = all_tokens.select("doc_id", "n", "at").mapInArrow(_pieces(order, length, slots, with_ids=False), PIECE)
    docs_of = F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"])  # at most `length` pieces
    return index.groupBy("slot", "shard").agg(F.sum("n").alias("n_tokens"), docs_of.alias("doc_ids")).withColumn("offset", F.col("slot") % slots * (2 * length + 1))


def sequences_from(spark: SparkSession, path: str, slot: int = 0, length: int = LENGTH, slots: int = SLOTS) -> DataFrame:
    """(slot, ids) of the shards below `path`, from a slot on: shards before it are not opened."""
    ship(spark)
    stride = 2 * length + 1
    schema = pa.schema([("slot", pa.int64()), ("ids", pa.binary())])
    shard = F.regexp_extract("path", "/([0-9]+)/part-([0-9]+)", 1).cast("long") + F.regexp_extract("path", "/([0-9]+)/part-([0-9]+)", 2).cast("long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).where(shard >= slot // slots).select(shard.alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                n = len(data) // stride
                begin = max(0, slot - number * slots)
                for at in range(begin, n, slots // 8 or 1):
                    records = range(at, min(n, at + (slots // 8 or 1)))
                    arrays = [pa.array([number * slots + i for i in records]), pa.array([bytes(data[i * stride : i * stride + 2 * length]) for i in records], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return files.mapInArrow(run, "slot long, ids binary")


def written(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, slots: int = SLOTS) -> DataFrame:
    """Writes shards into the shared folder; the index, with a digest of every record as it is read back from them."""
    path = scratch_path(spark, "shards")
    index = write_shards(docs, tokenizer or public_tokenizers.path(VOCABULARY), path, length, slots)
    read = sequences_from(spark, path, 0, length, slots).select("slot", F.sha2("ids", 256).alias("sha256"))
    return index.join(read, "slot").select("slot", "shard", "offset", "n_tokens", "doc_ids", "sha256")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all documents in training order, with their documents and the digest of their record."""
    return written(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
