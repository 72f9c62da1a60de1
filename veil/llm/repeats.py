r"""Substring dedup with prefix-partitioned suffix trees.

Every word of every document begins a suffix. Suffixes are partitioned by prefixes of variable length, found by counting:
a prefix that too many suffixes share is extended until what begins with it fits a task, and neighbouring short ones
share a group. A task sorts the suffixes of its group and takes the lengths that neighbours have in common, which are the
inner nodes of the subtree; the deep ones, at `window` words or more, are the repeats. Of the suffixes below a deep node
all but the one that comes first in the corpus begin a repeated window; neighbouring windows of a document merge into
maximal repeats, which are removed.

A suffix is followed to `window` words only, so its path is short enough to travel: 96 bits, in three edges of 4, 6 and
10 words (32 bits each, from 64-bit digests of the words), and its place. Prefixes are taken in twelve bits of the path.
Two windows count as equal if all 96 bits are.

Documents are put in the order of their ids first and stored with their place, in chunks of about half a million words:
a place is a chunk and a word in it, and places order as (document, word) do. The suffixes of a piece of a chunk are sorted
before they leave, and a window that repeats inside it is sent once: a passage that a third of all documents hold is one
suffix a piece. Groups are built in waves, so that a share of all suffixes is on disk at once; a wave reads the texts anew.

Defined cases: words are runs of `[^\x20\x09-\x0D]`; a null text has none. Documents of fewer words than the window hold no
window. A null id comes first; documents of one id follow the order of a digest of their text. Windows are judged on
the input, also where what they repeat is removed itself. Columns called like one that is added keep their name, and
the added one gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veil.functions.ordered import default_ranges, running_sums
from veil.llm.common import free_name, ship, slices, stored, table, texts
from veil.llm.places import sorted_ranges

WINDOW = 20
#: Words of a chunk, suffixes of a group, bits of a prefix step, bytes of a range of documents, shuffles one after another.
CHUNK, GROUP, BITS, RANGE_BYTES, WAVES = 1 << 19, 1 << 20, 12, 64 << 20, 3
#: Bits of a path; words of its edges as shares of the window.
PATH, EDGES = 96, (0.2, 0.5, 1.0)


def placed(docs: DataFrame, id_: str, text: str, chunk: int = CHUNK) -> DataFrame:
    """`docs` in the order of their ids, with `__chunk`, `__start` (the first word's place in the chunk) and `__words`; stored."""
    ship(docs.sparkSession)
    fields = [*docs.schema.fields, *StructType.fromDDL("__chunk long, __start long, __words long").fields]

    def run(batches):
        number, at = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches, text):
            n = np.fromiter((len(t.split()) for t in texts(batch, text)), np.int64, batch.num_rows)
            chunks, starts = [], []
            for k in n.tolist():
                if at >= chunk:
                    number, at = number + 1, 0
                chunks.append(number)
                starts.append(at)
                at += k
            arrays = [pa.array(chunks, pa.int64()), pa.array(starts, pa.int64()), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "__chunk", "__start", "__words"])

    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    ranges = int(str(size)) // RANGE_BYTES
    many = ranges if default_ranges(docs) < ranges < 1 << 20 else None  # a plan without statistics counts as endless
    tied = docs.withColumn("__digest", F.xxhash64(text))
    return stored(sorted_ranges(tied, [id_, "__digest"], many).drop("__digest").mapInArrow(run, StructType(fields)), "placed")


def pieces(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(chunk, texts, places of their first words): neighbouring documents of one chunk."""
    chunk, held, starts = None, [], []
    for batch in slices(batches, text):
        for c, start, t in zip(batch.column("__chunk").to_pylist(), batch.column("__start").to_pylist(), texts(batch, text)):
            if c != chunk and held:
                yield chunk, held, np.array(starts)
                held, starts = [], []
            chunk = c
            held.append(t)
            starts.append(start)
    if held:
        yield chunk, held, np.array(starts)


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit digest of each word."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return digests[coded.indices.to_numpy()]


def _edge(codes: np.ndarray, begin: int, end: int, n: int) -> np.ndarray:
    """32 bits of the words begin..end-1 after each of the first n places."""
    x = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(begin, end):
        x ^= codes[j : j + n]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x >> np.uint64(32)


def least_path(prefix: str) -> tuple[np.uint64, np.uint32]:
    path = prefix.ljust(PATH // 4, "0")
    return np.uint64(int(path[:16], 16)), np.uint32(int(path[16:], 16))


def before(high: np.ndarray, low: np.ndarray, prefix: str) -> np.ndarray:
    """Which paths are less than all that begin with a prefix."""
    h, l = least_path(prefix)
    return (high < h) | (high == h) & (low < l)


class Suffixes:
    """Sorted suffixes of a piece: path (`high`: 64 bits, `low`: 32), place, the first of each path only; `again`: places of the others.

    Only paths from the prefix `begin` on and before the prefix `end` are held.
    """

    def __init__(self, documents: list[bytes], starts: np.ndarray, window: int, begin: str = "", end: str | None = None):
        words = [d.split() for d in documents]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        codes = word_codes(list(chain.from_iterable(words)))
        n = max(0, len(codes) - window + 1)
        left = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n)  # words of the document from here on
        place = (np.repeat(starts - (np.cumsum(counts) - counts), counts)[:n] + np.arange(n)).astype(np.uint32)
        cuts = [0, *(max(1, round(share * window)) for share in EDGES)]
        a, b, c = (_edge(codes, i, j, n) for i, j in zip(cuts, cuts[1:]))
        high, low, own = a << np.uint64(32) | b, c.astype(np.uint32), left >= window
        if begin:
            own &= ~before(high, low, begin)
        if end:
            own &= before(high, low, end)
        high, low, place = high[own], low[own], place[own]
        order = sorted_by_path(high, low)
        high, low, place = high[order], low[order], place[order]
        first = ~deep(high, low)
        self.high, self.low, self.place, self.again = high[first], low[first], place[first], place[~first]

    def bound(self, prefix: str) -> int:
        """Number of suffixes before a prefix (hex digits)."""
        high, low = least_path(prefix)
        at = int(np.searchsorted(self.high, high))
        if low:
            to = int(np.searchsorted(self.high, high, "right"))
            at += int(np.searchsorted(self.low[at:to], low))
        return at

    def end(self, prefix: str) -> int:
        """Number of suffixes before the end of a prefix."""
        after = int(prefix or "0", 16) + 1
        return self.bound(f"{after:0{len(prefix)}x}") if prefix and after < 16 ** len(prefix) else len(self.high)

    def digits(self, begin: int, end: int, depth: int) -> np.ndarray:
        """The next prefix step of a stretch of suffixes, `depth` bits down the path."""
        shift = PATH - BITS - depth
        high, low = self.high[begin:end], self.low[begin:end].astype(np.uint64)
        x = high >> np.uint64(shift - 32) if shift >= 32 else high << np.uint64(32 - shift) | low >> np.uint64(shift)
        return (x & np.uint64((1 << BITS) - 1)).astype(np.int64)


def sorted_by_path(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Stable order by (high, low)."""
    order = np.argsort(high, kind="stable")
    same = high[order][1:] == high[order][:-1]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    if len(tied):
        some = order[tied]
        order[tied] = some[np.lexsort((low[some], high[some]))]
    return order


def deep(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which sorted suffixes share their whole path with the one before: both hang from one deep node."""
    return np.r_[False, (high[1:] == high[:-1]) & (low[1:] == low[:-1])] if len(high) else np.zeros(0, bool)


def prefixes(docs: DataFrame, text: str, window: int, group: int) -> DataFrame:
    """(prefix, n): a set of prefixes, none of which begins another, that covers all suffixes; n of them have it.

    More than `group` suffixes share a prefix only where they share the whole path, once a piece. A round extends those that
    are too large, of which there are at most as many as groups.
    """
    done, large, depth = None, [""], 0
    while large:

        def run(batches, heavy=tuple(large), depth=depth):
            for _, documents, starts in pieces(batches, text):
                s = Suffixes(documents, starts, window)
                rows = []
                for prefix in heavy:
                    digits, n = np.unique(s.digits(s.bound(prefix), s.end(prefix), depth), return_counts=True)
                    rows += [(f"{prefix}{d:0{BITS // 4}x}", k) for d, k in zip(digits.tolist(), n.tolist())]
                names, n = (list(c) for c in zip(*rows)) if rows else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64())], names=["prefix", "n"])

        counted = docs.select("__chunk", "__start", text).mapInArrow(run, "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        counted, depth = stored(counted, "prefixes"), depth + BITS
        split = F.col("n") > (group if depth < PATH else 1 << 62)
        large = [r["prefix"] for r in counted.where(split).select("prefix").collect()]
        kept = counted.where(~split)
        done = kept if done is None else done.union(kept)
    return done


def borders(prefixes_: DataFrame, group: int) -> list[str]:
    """First prefixes of the groups: neighbours share one while they hold about `group` suffixes. As many as groups."""
    summed = running_sums(prefixes_, "prefix", ["n"])
    firsts = summed.groupBy(F.expr(f"(cum_n - n) div {group}")).agg(F.min("prefix").alias("first"))
    return sorted(r["first"] for r in firsts.select("first").collect())


def _bundles(text: str, window: int, first: list[str], end: str | None):
    """Suffixes of a piece by group, for the groups that begin with `first`; what repeats inside the piece goes along, past the trees."""

    def run(batches):
        for chunk, documents, starts in pieces(batches, text):
            s = Suffixes(documents, starts, window, first[0], end)
            edges = np.array([0, *(s.bound(p) for p in first[1:]), len(s.high)])
            groups = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            columns = [[x[edges[g] : edges[g + 1]].tobytes() for g in groups] for x in (s.high, s.low, s.place)]
            if len(s.again):
                groups.append(-1 - chunk)
                for column, x in zip(columns, (b"", b"", np.sort(s.again).tobytes())):
                    column.append(x)
            n = len(groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int64()), pa.array([chunk] * n, pa.int64()), pa.array([int(starts[0])] * n, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)],
                names=["group", "chunk", "start", "high", "low", "place"],
            )

    return run


def _subtree(rows: pa.Table) -> pa.Table:
    """(chunk, places): below each deep node of a group's subtree, the places of all suffixes but the first."""
    names = ["chunk", "places"]
    if rows.column("group")[0].as_py() < 0:
        return pa.Table.from_arrays([rows.column("chunk"), rows.column("place")], names=names)
    rows = rows.sort_by([("chunk", "ascending"), ("start", "ascending")])
    high, low, place = (
        np.concatenate([np.frombuffer(x, kind) for x in rows.column(c).to_pylist()]) for c, kind in (("high", np.uint64), ("low", np.uint32), ("place", np.uint32))
    )
    owner = np.repeat(np.arange(rows.num_rows), pc.binary_length(rows.column("place")).to_numpy() // 4)
    order = sorted_by_path(high, low)
    again = np.sort(order[deep(high[order], low[order])])
    owners, begin = np.unique(owner[again], return_index=True)
    parts = np.split(place[again], begin[1:]) if len(owners) else []
    return pa.Table.from_arrays([rows.column("chunk").combine_chunks().take(pa.array(owners)), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)


def repeated_places(docs: DataFrame, text: str, window: int = WINDOW, group: int = GROUP, waves: int = WAVES) -> DataFrame:
    """(chunk, places): words of `placed` documents that begin a window which also begins earlier; stored.

    Groups are handled in waves, each with a shuffle of its own whose files go when it ends.
    """
    ship(docs.sparkSession)
    first = borders(prefixes(docs, text, window, group), group) or [""]
    per_wave, found = -(-len(first) // waves), None
    for i in range(0, len(first), per_wave):
        own, end = ["" if i == 0 else first[i], *first[i + 1 : i + per_wave]], first[i + per_wave] if i + per_wave < len(first) else None
        suffixes = docs.select("__chunk", "__start", text).mapInArrow(_bundles(text, window, own, end), "group long, chunk long, start long, high binary, low binary, place binary")
        wave = stored(suffixes.groupBy("group").applyInArrow(_subtree, "chunk long, places binary"), "repeats")
        found = wave if found is None else found.union(wave)
    return found


def _removal(text: str, window: int, schema: pa.Schema):
    """Words of a chunk outside all repeated windows."""

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        starts, counts = (rows.column(c).to_numpy() for c in ("__start", "__words"))
        places = [np.frombuffer(x, np.uint32) for x in marks.column("places").to_pylist()]
        begin = np.unique(np.concatenate(places)).astype(np.int64) if places else np.zeros(0, np.int64)
        step = np.zeros(int((starts + counts).max(initial=0)) + 1, np.int64)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + window, -1)
        gone = np.cumsum(step) > 0
        spans, kept = [], []
        for start, n, t in zip(starts.tolist(), counts.tolist(), texts(rows, text)):
            own = gone[start : start + n]
            words = t.split()
            if own.any():
                edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).tolist()
                spans.append([{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                words = [words[i] for i in np.flatnonzero(~own).tolist()]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        own = [c for c in rows.column_names if c not in ("__chunk", "__start", "__words")]
        arrays = [*(rows.column(c).combine_chunks() for c in own), pa.array(counts), pa.array(spans, schema.field(-2).type), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(arrays, names=schema.names).cast(schema)

    return run


def deduplicated(docs: DataFrame, id_: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP, chunk: int = CHUNK, waves: int = WAVES) -> DataFrame:
    """`docs` with `n_words`, `repeats` (spans of words that are removed, ends exclusive) and `kept` (what is left, UTF-8)."""
    rows = placed(docs, id_, text, chunk)
    marks = repeated_places(rows, text, window, group, waves)
    names = [free_name(docs, c) for c in ("n_words", "repeats", "kept")]
    added = StructType.fromDDL(f"`{names[0]}` long, `{names[1]}` array<struct<begin: long, end: long>>, `{names[2]}` binary")
    schema = StructType([*docs.schema.fields, *added.fields])
    pairs = rows.groupBy("__chunk").cogroup(marks.groupBy("chunk"))
    return pairs.applyInArrow(_removal(text, window, to_arrow_schema(schema)), schema)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 20-word windows that occur earlier."""
    out = deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE k > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT u.doc_id, count(c.i) AS n_removed, coalesce(string_agg(u.word, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL), '') AS kept
      FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
