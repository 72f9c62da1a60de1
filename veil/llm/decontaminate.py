r"""Benchmark decontamination with suffix arrays over the training text.

The documents of a shard (about a million words) become one array of word codes with a suffix array over it. Every
suffix of every benchmark item is looked up by binary search, word by word, in all shards; a suffix whose first
`window` words are found gives the places of a verbatim match. Matches of consecutive suffixes at consecutive places
are one longer match, so the longest verbatim matches and their places follow from the same search. Documents with a
match are then removed.

Items are searched in blocks, each against all documents; a block, which is what is broadcast, has BLOCK_BYTES of text, and
at most one item more. Equal item texts are searched once, under their least id; the other ids join the hits at the end. A
block adds its hits to those of the blocks before.

Defined cases: words are runs of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased. An item of
fewer than `window` words matches as a whole; an item without words matches nothing. Null texts have no words. An item
without an id marks words, and is not listed. Repeated item ids are one item, repeated documents are documents each.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from veil.functions.ordered import running_sums
from veil.llm.common import free_name, stored, table, texts, with_columns

WINDOW = 10
#: Words of a shard, bytes of item text in a block.
SHARD, BLOCK_BYTES = 1 << 20, 16 << 20
#: Lower-cases A-Z and turns every byte that is in no word into a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Suffixes:
    """The suffixes of a block's items that can begin a match: codes of their words, and how many words must agree."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        split = [(name, w) for name, text in items if (w := words(text))]
        self.names = [name for name, _ in split]
        flat = list(chain.from_iterable(w for _, w in split))
        codes, vocabulary = pd.factorize(np.array(flat, dtype=object))
        self.codes, self.vocabulary = codes.astype(np.int64), list(vocabulary)
        counts = np.array([len(w) for _, w in split], np.int64)
        starts = np.cumsum(counts) - counts
        n = np.maximum(counts - window + 1, 1)
        self.item = np.repeat(np.arange(len(split)), n)
        self.within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = starts[self.item] + self.within
        self.length = np.minimum(counts, window)[self.item]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, in the order of their first `depth` words at least; ranks are doubled, ties only refined."""
    n = len(codes)
    following = np.r_[codes[1:], 0]
    key = codes.astype(np.int64) * (int(codes.max(initial=0)) + 1) + following
    order = np.argsort(key)
    rank, tied = _rank(key[order], order, n)
    known = 2
    while known < depth and tied.any():
        at = np.flatnonzero(tied)
        suffix = order[at]
        beyond = suffix + known
        key = rank[suffix] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(key)
        key = key[by]
        order[at] = suffix[by]
        begin = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = at[np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))]
        tied[at] = ~(begin & np.r_[begin[1:], True])
        known *= 2
    return order


def _rank(key: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of every suffix (place of the first of its ties), and which places of the order are tied."""
    begin = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    return rank, ~(begin & np.r_[begin[1:], True])


def _bound(codes, order, lo, hi, depth, wanted, right: bool):
    """First place in [lo, hi) of each query whose word at `depth` is not less than (or, right, greater than) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        word = codes[order[np.where(open_, mid, 0)] + depth]
        up = open_ & ((word <= wanted) if right else (word < wanted))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def search(suffixes: Suffixes, shard: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All matches in a shard: (suffix, document, word of the document), each for the full length of the suffix's window."""
    nothing = (np.zeros(0, np.int64),) * 3
    counts = np.fromiter(map(len, shard), np.int64, len(shard))
    if not counts.sum() or not len(suffixes.start):
        return nothing
    flat, vocabulary = pd.factorize(np.array(list(chain.from_iterable(shard)), dtype=object))
    # word codes from 1 on, and a zero that ends each document
    codes = np.zeros(len(flat) + len(shard), np.int64)
    document = np.repeat(np.arange(len(shard)), counts)
    codes[np.arange(len(flat)) + document] = flat + 1
    order = suffix_array(codes, int(suffixes.length.max()))
    local = pd.Index(vocabulary).get_indexer(suffixes.vocabulary) + 1
    wanted = np.where(local == 0, -1, local)[suffixes.codes]
    first = np.searchsorted(codes[order], np.arange(len(vocabulary) + 2))
    codes = np.r_[codes, np.zeros(int(suffixes.length.max()), np.int64)]

    query = np.flatnonzero(wanted[suffixes.start] > 0)
    word = wanted[suffixes.start[query]]
    lo, hi, depth = first[word], first[word + 1], 1
    found = []
    while len(query):
        full = suffixes.length[query] == depth
        found.append((query[full], lo[full], hi[full]))
        query, lo, hi = query[~full], lo[~full], hi[~full]
        word = wanted[suffixes.start[query] + depth]
        lo, hi = _bound(codes, order, lo, hi, depth, word, False), _bound(codes, order, lo, hi, depth, word, True)
        on = (lo < hi) & (word > 0)
        query, lo, hi, depth = query[on], lo[on], hi[on], depth + 1
    query, lo, hi = (np.concatenate(x) for x in zip(*found)) if found else nothing
    size = hi - lo
    suffix = np.repeat(query, size)
    place = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    begins = np.cumsum(counts + 1) - (counts + 1)
    owner = np.searchsorted(begins, place, "right") - 1
    return suffix, owner, place - begins[owner]


def longest(suffixes: Suffixes, suffix: np.ndarray, owner: np.ndarray, place: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Per document the longest match: (words, item, word of the document), the first of ties."""
    if not len(suffix):
        return {}
    item, within = suffixes.item[suffix], suffixes.within[suffix]
    by = np.lexsort((within, place - within, item, owner))
    item, within, owner, place, length = item[by], within[by], owner[by], place[by], suffixes.length[suffix][by]
    joins = (owner[1:] == owner[:-1]) & (item[1:] == item[:-1]) & (place[1:] == place[:-1] + 1) & (within[1:] == within[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~joins])
    size = np.diff(np.r_[head, len(owner)]) - 1 + length[head]
    best: dict[int, tuple[int, int, int]] = {}
    for o, n, i, p in zip(owner[head].tolist(), size.tolist(), item[head].tolist(), place[head].tolist()):
        if o not in best or n > best[o][0]:
            best[o] = (n, i, p)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int, before: list) -> list[tuple[int, int]]:
    """Union of word ranges, as ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    for r in before:
        edge[r["from"]] += 1
        edge[r["to"]] -= 1
    on = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    change = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def _scan(suffixes: Suffixes, docs: list[bytes], before: list[dict | None]) -> list[dict]:
    """Hits of every document of a batch, shard by shard, joined with the hits of earlier blocks."""
    out, shard, size, at = [], [], 0, 0
    for i, text in enumerate(docs):
        shard.append(words(text))
        size += len(shard[-1])
        if size >= SHARD or i == len(docs) - 1:
            out += _shard_hits(suffixes, shard, before[at : i + 1])
            shard, size, at = [], 0, i + 1
    return out


def _shard_hits(suffixes: Suffixes, shard: list[list[bytes]], before: list[dict | None]) -> list[dict]:
    suffix, owner, place = search(suffixes, shard)
    best = longest(suffixes, suffix, owner, place)
    by = np.argsort(owner, kind="stable")
    suffix, owner, place = suffix[by], owner[by], place[by]
    edges = np.searchsorted(owner, np.arange(len(shard) + 1))
    out = []
    for d, own in enumerate(shard):
        old = before[d] or {"words": len(own), "ranges": [], "items": [], "longest": 0, "longest_item": None, "longest_at": None}
        part = slice(edges[d], edges[d + 1])
        if edges[d] == edges[d + 1]:
            out.append(old)
            continue
        names = {suffixes.names[i] for i in np.unique(suffixes.item[suffix[part]])} | set(old["items"])
        ranges = _covered(place[part], suffixes.length[suffix[part]], len(own), old["ranges"])
        new = {"words": len(own), "ranges": [{"from": a, "to": b} for a, b in ranges], "items": sorted(names - {None})}
        n, i, p = best[d]
        far = (n, suffixes.names[i], p) if n > old["longest"] else (old["longest"], old["longest_item"], old["longest_at"])
        out.append(new | dict(zip(("longest", "longest_item", "longest_at"), far)))
    return out


RANGE = StructType([StructField("from", LongType()), StructField("to", LongType())])
HITS = StructType([
    StructField("words", LongType()), StructField("ranges", ArrayType(RANGE)), StructField("items", ArrayType(StringType())),
    StructField("longest", LongType()), StructField("longest_item", StringType()), StructField("longest_at", LongType()),
])


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "hits") -> DataFrame:
    """`docs` with a column of hits: number of words, ranges of words inside matches, ids of matching items (sorted as
    strings), and length in words, item and place of the longest match.

    Runs one pass over `docs` for each block of items; what one pass found is written before the next.
    """
    spark = docs.sparkSession
    searched, copies = item_blocks(items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")), block_bytes)
    numbers = sorted(r["block"] for r in searched.select("block").distinct().collect())  # total bytes over those of a block
    for k, b in enumerate(numbers or [0]):
        rows = searched.where(F.col("block") == b).collect()  # a block
        block = Suffixes([(r["id"], r["text"].encode("utf-8", "replace")) for r in rows], window)
        docs = _pass(stored(docs, "hits") if k else docs, spark.sparkContext.broadcast(block), text, name, first=not k)
    return docs if copies.isEmpty() else _with_copies(docs, copies, name)


def item_blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(id, text, block): one row per text, in blocks by a running sum of bytes; and (id, other): further ids of a text. Both stored."""
    known = items.where("text IS NOT NULL").withColumn("key", F.md5(F.col("text").cast("binary")))
    texts_ = known.groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    summed = running_sums(texts_.withColumn("bytes", F.octet_length("text") + 16), "key", ["bytes"])
    searched = stored(summed.select("key", "id", "text", F.expr(f"(cum_bytes - bytes) div {block_bytes}").alias("block")), "items")
    ids = known.select("key", F.col("id").alias("other")).where("other IS NOT NULL").distinct()
    copies = searched.select("key", "id").join(ids, "key").where("other <> id").select("id", "other")
    return searched.select("id", "text", "block"), stored(copies, "copies")


def _with_copies(docs: DataFrame, copies: DataFrame, name: str) -> DataFrame:
    """Adds the further ids of the items that were hit. Only rows with hits and ids are shuffled, without texts."""
    row = free_name(docs, "row")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "hits")
    hit = docs.select(row, F.explode(f"{name}.items").alias("__id"))
    more = hit.join(copies.withColumnRenamed("id", "__id"), "__id").groupBy(row).agg(F.collect_set("other").alias("__more"))
    joined = docs.join(more, row, "left")
    every = F.array_sort(F.array_union(f"{name}.items", F.coalesce("__more", F.array().cast("array<string>"))))
    return joined.withColumn(name, F.col(name).withField("items", every)).drop(row, "__more")


def _pass(docs: DataFrame, block, text: str, name: str, first: bool) -> DataFrame:
    """Searches one block of items in all documents. All but the first pass replace the hits of the passes before."""
    target = name if first else free_name(docs, f"{name}_next")

    def run(batches):
        for batch in batches:
            found = texts(batch, text)
            before = [None] * len(found) if first else batch.column(batch.schema.get_field_index(name)).to_pylist()
            yield batch, [_scan(block.value, found, before)]

    out = with_columns(docs, text, StructType([StructField(target, HITS)]), run)
    return out if first else out.drop(name).withColumnRenamed(target, name)


def n_hit(hits: str = "hits"):
    """Number of document words inside matches."""
    return F.aggregate(F.col(f"{hits}.ranges"), F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs."""
    name = free_name(docs, "hits")
    return matches(docs, items, text=text, window=window, name=name).where(F.size(f"{name}.ranges") == 0).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and matching items of every document, and its longest match."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = matches(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        F.col("hits.words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.ranges") > 0).alias("contaminated"),
        F.col("hits.longest").alias("longest"),
        F.col("hits.longest_item").alias("longest_item"),
        F.col("hits.longest_at").alias("longest_at"),
    )
