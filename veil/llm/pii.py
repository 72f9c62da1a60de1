r"""Personal data: base rules, and further spans chosen among candidates by boosted trees.

Base rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers; their spans always stay. Generators of high
recall propose further, overlapping spans of the four kinds. Each candidate is described by its format and its context
(not by the checks of the base rules) and labelled as personal if a base rule matches it, or matches it once its loose
form is undone: '@' spelled out, spaces around the dots of an address, dots in a card number, a phone number without '+'
behind a word for phones. Trees are boosted on these and on loose forms made from base spans (`loosened`), since a sample
may hold few of its own, and give every candidate a probability. Candidates above the threshold of their kind that overlap no
base span are added, the likeliest first.

Thresholds are set on documents that the trees have not seen, and only on candidates that overlap no base span, as no others
can be added. There are two such sets: the documents as they are, and the documents with their base spans in loose forms. A
threshold must keep the wanted precision on either: made forms, of which there are many, cannot outvote errors on what
documents really hold, and documents without any loose form cannot forbid to look for them unless something wrong looks
like one. `report` measures precision and recall of added spans on made forms.

Learning takes the candidates of all documents, which Spark ML grows its trees on. Texts are searched whole, in time
proportional to their length.

Defined cases: a null text is empty and has no spans. Rows are searched on their own, whatever their id. If candidates
are missing or all of one label, nothing is added.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from veil.llm.common import free_name, ship, slices, stored, table, texts, with_columns

KINDS = ("email", "ip", "card", "phone")
PRECISION, CONFIRMED = 0.99, 20
ROUNDS, DEPTH, BUCKETS = 15, 3, 1000
#: Candidates that a task describes at once.
AT_ONCE = 10_000
#: Candidates that grow trees; held-out ones of documents as they are; held-out ones of documents with made forms.
GROWN, HELD, MADE = 0, 1, 2

#: The base rules.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs of the characters that the rules for numbers can match; no match crosses their ends.
NUMERIC = re.compile(r"[0-9+][\x20().0-9+-]*")

#: Words before a span that speak for a kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
LOOSE_NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9])*")
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]++(?:\x20?\.\x20?[0-9]++){3}")
SPOKEN_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,64}){0,5}", re.I)
DOTTED_CARD = re.compile(r"[0-9]{4}(?:\.[0-9]{4}){3}")
PHONE_WORD = re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I)
AROUND, REACH = 32, 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of the e-mail rule: for each @ the local part before it, not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, in the order of their starts, then of the kinds."""
    found = list(_emails(text)) if "@" in text else []
    for run in NUMERIC.finditer(text):
        a, b = run.span()
        if b - a < 7:  # the shortest match, an IP address
            continue
        found += [("ip", *m.span()) for m in IP.finditer(text, a, b) if all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in m[0].split("."))]
        for m in CARD.finditer(text, a, b):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        found += [("phone", *m.span()) for m in PHONE.finditer(text, a, b) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=_order)


def _order(span: tuple) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, of high recall; they may overlap."""
    found = set()
    at = text.find("@")
    while at >= 0:
        a = b = at
        while a > 0 and at - a < REACH and text[a - 1] in LOCAL:
            a -= 1
        while b + 1 < len(text) and b - at < REACH and (text[b + 1] in LOCAL):
            b += 1
        if a < at < b:
            found.add(("email", a, b + 1))
            found.add(("email", a, at + 1 + len(text[at + 1 : b + 1].rstrip(".-_%+"))))
        at = text.find("@", at + 1)
    if "(at" in (lower := text.lower()) or "[at" in lower:
        found.update(("email", *m.span()) for m in SPOKEN_MAIL.finditer(text))
    for run in NUMERIC.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in LOOSE_NUMBER.finditer(text, a, b):
            n = sum(c.isdigit() for c in m[0])
            if 12 <= n <= 19:
                found.add(("card", *m.span()))
            if 7 <= n <= 15:
                found.add(("phone", *m.span()))
        found.update(("ip", *m.span()) for m in LOOSE_IP.finditer(text, a, b) if m.end() - m.start() <= REACH)
    return sorted(found, key=_order)


def confirmed_loose(text: str, span: tuple[str, int, int]) -> bool:
    """Whether a candidate that is no base span becomes one when its loose form is undone."""
    kind, a, b = span
    body = text[a:b]
    if kind == "email" and "@" not in body:
        plain = re.sub(r"\x20?[\[(]dot[\])]\x20?", ".", re.sub(r"\x20?[\[(]at[\])]\x20?", "@", body, flags=re.I), flags=re.I)
    elif kind == "ip" and " " in body:
        plain = body.replace(" ", "")
    elif kind == "card" and DOTTED_CARD.fullmatch(body):
        plain = body.replace(".", "")
    elif kind == "phone" and body[0] != "+" and PHONE_WORD.search(text, max(0, a - AROUND), a):
        plain = "+" + body
    else:
        return False
    return (kind, 0, len(plain)) in base_spans(plain)


def loosened(text: str, base: list[tuple[str, int, int]], turn: int = 0) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its base spans in loose forms, which take turns, and the new spans."""
    parts, out, at, size = [], [], 0, 0
    for i, (kind, a, b) in enumerate(base, turn):
        if a < at:
            continue
        body = text[a:b]
        digits = "".join(c for c in body if c.isdigit())
        bare = body.lstrip("+")
        lead, form = {
            "email": lambda: [("", body.replace("@", " (at) ")), ("", body.replace("@", "[at]")), ("", " [at] ".join([body.split("@")[0], body.split("@")[1].replace(".", " [dot] ")]))],
            "ip": lambda: [("", body.replace(".", " . ")), ("", body.replace(".", ". "))],
            "card": lambda: [("", ".".join(digits[j : j + 4] for j in range(0, len(digits), 4)))],
            "phone": lambda: [("", bare), ("tel ", digits), ("call ", bare), ("", re.sub(r"[\x20()-]+", ".", bare)), ("phone: ", bare)],
        }[kind]()[i % {"email": 3, "ip": 2, "card": 1, "phone": 5}[kind]]
        parts += [text[at:a], lead, form]
        size += a - at + len(lead)
        out.append((kind, size, size + len(form)))
        size, at = size + len(form), b
    return "".join([*parts, text[at:]]), out


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    body, before = text[a:b], text[max(0, a - AROUND) : a].lower()
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", body) if g] or [0]
    digits = sum(c.isdigit() for c in body)
    side = lambda c: 0.0 if not c or c.isspace() else 2.0 if c.isalnum() else 1.0
    return [
        *(float(kind == k) for k in KINDS),
        float(len(body)), float(digits), float(sum(c.isalpha() for c in body)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]), float(groups[-1]),
        *(float(body.count(c)) for c in " .-(_@"),
        float(body.startswith("+")), float(len(set(body))) / max(1, len(body)),
        side(text[a - 1 : a]), side(text[b : b + 1]),
        *(float(any(w in before for w in words)) for words in CONTEXT.values()),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values, and a threshold for each kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, x: list[float]) -> float:
        margin = sum(w * _leaf(t, x) for w, t in zip(self.weights, self.trees))
        return float(1 / (1 + np.exp(-2 * margin)))


def _leaf(node, x: list[float]) -> float:
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def parse_tree(text: str):
    """A tree from Spark's description of it."""
    lines = iter(line.strip() for line in text.splitlines() if re.match(r"\s*(If|Else|Predict)", line))

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        next(lines)  # the Else of the same test
        return int(m[1]), float(m[2]), left, node()

    return node()


def learn(docs: DataFrame, text: str = "text", precision: float = PRECISION, confirmed: int = CONFIRMED) -> Trees:
    """Trees and thresholds from the candidates of all documents; two thirds of those grow trees, one third sets thresholds."""
    ship(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("label", pa.float64()), ("features", pa.list_(pa.float64())), ("fold", pa.int32())])

    def described(raw):
        own = raw.decode("utf-8", "replace")
        known = base_spans(own)
        base, taken, held = set(known), Taken(known), len(raw) % 3 == 0
        for c in candidates(own):
            free = not taken.meets(c)
            if free or not held:
                yield c[0], float(c in base or (free and confirmed_loose(own, c))), features(own, c), HELD if held else GROWN
        if known:
            made, planted = loosened(own, sorted(base, key=_order), len(raw) // 3)
            taken, right = Taken(base_spans(made)), set(planted)
            for c in candidates(made):
                if not taken.meets(c):
                    yield c[0], float(c in right or confirmed_loose(made, c)), features(made, c), MADE if held else GROWN

    def run(batches):
        rows = chain.from_iterable(described(raw) for batch in slices(batches, "text") for raw in texts(batch, "text"))
        while part := list(islice(rows, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, label double, features array<double>, fold int")
    found = stored(found, "candidates").withColumn("x", array_to_vector("features"))
    grow, hold = found.where(F.col("fold") == GROWN), found.where(F.col("fold") != GROWN)
    if grow.select("label").distinct().count() < 2:
        return Trees()
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, seed=1).fit(grow)
    trees = Trees(tuple(parse_tree(t.toDebugString) for t in model.trees), tuple(model.treeWeights))
    scored = model.transform(hold.select("kind", "label", "fold", "x")).withColumn("bucket", F.floor(vector_to_array("probability")[1] * BUCKETS).cast("int"))
    # at most (kinds x folds x buckets) rows
    counts = scored.groupBy("kind", "fold", "bucket").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")).collect()
    thresholds = {}
    for kind in KINDS:
        held, made = ({r["bucket"]: (r["right"], r["n"]) for r in counts if r["kind"] == kind and r["fold"] == fold} for fold in (HELD, MADE))
        limit = threshold(held, made, precision, confirmed)
        if limit is not None:
            thresholds[kind] = limit / BUCKETS
    return Trees(trees.trees, trees.weights, thresholds)


def threshold(held: dict[int, tuple[float, int]], made: dict[int, tuple[float, int]], precision: float, confirmed: int) -> int | None:
    """The lowest bucket of probability from which on at least `precision` of the candidates of either set are right.

    Both map buckets to (right ones, all). At least `confirmed` candidates of the two together must be right. A set without
    candidates from that bucket on does not object.
    """
    best, sums = None, [[0.0, 0], [0.0, 0]]
    for bucket in sorted(held.keys() | made.keys(), reverse=True):
        for total, counts in zip(sums, (held, made)):
            right, n = counts.get(bucket, (0.0, 0))
            total[0] += right
            total[1] += n
        if sums[0][0] + sums[1][0] >= confirmed and all(right >= precision * n for right, n in sums):
            best = bucket
    return best


def added_spans(text: str, base: list[tuple[str, int, int]], trees: Trees) -> list[tuple[str, int, int]]:
    """Chosen candidates that overlap no base span, nor a likelier chosen one."""
    if not trees.thresholds:
        return []
    taken = Taken(base)
    scored = [(-trees.probability(features(text, c)), c) for c in candidates(text) if c[0] in trees.thresholds and not taken.meets(c)]
    out = []
    for p, c in sorted(scored, key=lambda x: (x[0], x[1][1], -x[1][2], _order(x[1]))):
        if -p >= trees.thresholds[c[0]] and not taken.meets(c):
            taken.add(c)
            out.append(c)
    return out


class Taken:
    """Ranges of a text that are taken, as disjoint ranges in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: tuple[str, int, int]) -> bool:
        at = bisect_right(self.ends, span[1])
        return at < len(self.starts) and self.starts[at] < span[2]

    def add(self, span: tuple[str, int, int]) -> None:
        """Takes a range that meets none of the taken ones."""
        at = bisect_right(self.ends, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def find(docs: DataFrame, trees: Trees, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """`docs` with the base spans and all spans of each whole text, in the order of their starts."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # some hundred nodes

    def run(batches):
        as_rows = lambda xs: [dict(zip(("kind", "start", "end"), x)) for x in xs]
        for batch in batches:
            first, every = [], []
            for raw in texts(batch, text):
                own = raw.decode("utf-8", "replace")
                known = base_spans(own)
                first.append(as_rows(known))
                every.append(as_rows(sorted(known + added_spans(own, known, shared.value), key=_order)))
            yield batch, [first, every]

    return with_columns(docs, text, StructType([StructField(base, ArrayType(SPAN), False), StructField(spans, ArrayType(SPAN), False)]), run)


def report(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """(kind, planted, added, right, precision, recall) of added spans, over all documents with their base spans in loose forms.

    Planted are the forms that no base rule matches any more. An added span is right if it is one of them, or becomes a base
    span once its loose form is undone; of those, only planted ones count for recall.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # some hundred nodes
    ship(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("planted", "added", "right", "found"))])

    def run(batches):
        for batch in slices(batches, "text"):
            sums = {k: [0, 0, 0, 0] for k in KINDS}
            for raw in texts(batch, "text"):
                own = raw.decode("utf-8", "replace")
                base = base_spans(own)
                if not base:
                    continue
                made, forms = loosened(own, base, len(raw) // 3)
                known = base_spans(made)
                taken = Taken(known)
                planted = {s for s in forms if not taken.meets(s)}
                for s in planted:
                    sums[s[0]][0] += 1
                for s in added_spans(made, known, shared.value):
                    sums[s[0]][1] += 1
                    sums[s[0]][2] += s in planted or confirmed_loose(made, s)
                    sums[s[0]][3] += s in planted
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([k for k in sums], *zip(*sums.values())), schema)], schema=schema)

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, planted long, added long, right long, found long")
    total = found.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("planted", "added", "right", "found")])
    return total.select("kind", "planted", "added", "right", F.try_divide("right", "added").alias("precision"), F.try_divide("found", "planted").alias("recall"))


def redacted(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in brackets; overlapping spans are replaced as one."""
    names = [free_name(docs, n) for n in ("base", "spans")]
    found = find(docs, trees, text, *names)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        gap = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    return found.withColumn(text, F.aggregate(names[1], begin, step, rest)).drop(*names)


def _listed(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: spans of the base rules by kind, and all spans."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find(docs, learn(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
