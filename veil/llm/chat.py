r"""Chat formatting: records of many layouts become canonical turns, and turns become one string with a loss mask.

A layout is known by the nested field paths that it has. The paths that any mapping mentions are looked for in a
record (in a table with typed columns: in its schema), and the hash of those present selects a declarative mapping from
paths to turns; fields that no mapping mentions do not matter. Everything is DataFrame expressions.

Turns are written as `<|im_start|>role\ntext<|im_end|>\n`. In roles and texts `&`, `<` and `[` are replaced by entities, and
in roles line feeds too, so no text can hold a control string of this or another template; reading replaces them back.
The mask has one entry for each turn: start and length in code points, behind the mark that begins the turn's segment
(segments are what the end marks separate), or null for a turn that is not learned.

Defined cases: a null role or text is empty. A record of no known layout has null turns and a null layout. Turns are in
the order of their number, then role and text; a null number comes first. A null conversation id is one conversation. A
conversation is one row of output, so its turns must fit one task; conversations are spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from veil.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: What stands for the characters that control strings begin with. The ampersand is first when writing, last when reading.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LINE_FEED = ("\n", "&#10;")


@dataclass(frozen=True)
class Record:
    """Where a mapping finds its fields: columns, or a variant parsed from JSON."""

    variant: Column | None = None

    def field(self, path: str) -> Column:
        """A value as text."""
        if self.variant is None:
            return F.col(path).cast("string")
        return F.try_variant_get(self.variant, f"$.{path}", "string")

    def items(self, path: str, role: str, text: str) -> Column:
        """(role, text) of the entries of an array."""
        if self.variant is None:
            entries = F.col(path)
        else:
            entries = F.try_variant_get(self.variant, f"$.{path}", f"array<struct<`{role}`: string, `{text}`: string>>")
        return F.transform(entries, lambda x: turn(x[role], x[text]))


def turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def renamed(turns: Column, names: dict[str, str]) -> Column:
    """Turns with roles replaced by their canonical names."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.element_at(pairs, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it must have, those it may have, and its turns."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Record], Column]
    optional: tuple[str, ...] = ()


def _asked(record: Record, question: str, more: str | None, answer: str) -> Column:
    """A user turn (with a second field on a line of its own, if it has text) and an assistant turn."""
    asked = record.field(question)
    if more:
        extra = F.coalesce(record.field(more), F.lit(""))
        asked = F.concat(F.coalesce(asked, F.lit("")), F.when(extra != "", F.concat(F.lit("\n"), extra)).otherwise(F.lit("")))
    return F.array(turn("user", asked), turn("assistant", record.field(answer)))


SHARED_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turn_row", ("role", "text"), lambda r: F.array(turn(r.field("role"), r.field("text"))), ("conv_id", "turn")),
    Mapping("messages", ("messages[].content", "messages[].role"), lambda r: r.items("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), lambda r: renamed(r.items("conversations", "from", "value"), SHARED_NAMES)),
    Mapping("instruction", ("instruction", "output"), lambda r: _asked(r, "instruction", None, "output")),
    Mapping("instruction_input", ("input", "instruction", "output"), lambda r: _asked(r, "instruction", "input", "output")),
    Mapping("prompt_completion", ("completion", "prompt"), lambda r: _asked(r, "prompt", None, "completion")),
    Mapping("prompt_response", ("prompt", "response"), lambda r: _asked(r, "prompt", None, "response")),
    Mapping("question_answer", ("answer", "question"), lambda r: _asked(r, "question", None, "answer")),
)


def known_paths(mappings=MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in (*m.paths, *m.optional)})


def schema_paths(schema: StructType, before: str = "") -> list[str]:
    """Nested field paths of a schema; array entries are written `[]`."""
    out = []
    for f in schema.fields:
        path, kind = before + f.name, f.dataType
        out.append(path)
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            out += schema_paths(kind.elementType, f"{path}[].")
        elif isinstance(kind, StructType):
            out += schema_paths(kind, f"{path}.")
    return out


def fingerprint(paths: list[str]) -> Column:
    """Hash of a set of field paths; a constant, which Spark folds."""
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def record_fingerprint(variant: Column, mappings=MAPPINGS) -> Column:
    """Hash of the known field paths that a record has; of an array the first entry is looked at."""
    there = lambda p: F.try_variant_get(variant, "$." + p.replace("[]", "[0]"), "variant").isNotNull()
    return F.xxhash64(F.array_join(F.array_compact(F.array(*(F.when(there(p), F.lit(p)) for p in known_paths(mappings)))), "\n"))


def canonical(df: DataFrame, record: str | None = None, mappings=MAPPINGS) -> DataFrame:
    """`df` with the fingerprint, the layout's name and the turns of each row.

    record: a column of JSON text whose layouts may differ from row to row. Without it the layout is that of `df`'s columns.
    """
    if record is None:
        source, known = Record(), set(known_paths(mappings))
        df = df.withColumn("fingerprint", fingerprint([p for p in schema_paths(df.schema) if p in known]))
        usable = [m for m in mappings if set(m.paths) <= set(schema_paths(df.schema))]
    else:
        df = df.withColumn("__variant", F.try_parse_json(record))
        source, usable = Record(F.col("__variant")), list(mappings)
        df = df.withColumn("fingerprint", record_fingerprint(F.col("__variant"), mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for m in usable:
        kinds = [fingerprint([*m.paths, *extra]) for n in range(len(m.optional) + 1) for extra in combinations(m.optional, n)]
        chosen = F.col("fingerprint").isin(*kinds)
        layout, turns = F.when(chosen, m.name).otherwise(layout), F.when(chosen, m.turns(source)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns).drop("__variant")


def escaped(text: Column, role: bool = False) -> Column:
    for plain, entity in (*ENTITIES, *([LINE_FEED] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column, role: bool = False) -> Column:
    for plain, entity in reversed((*ENTITIES, *([LINE_FEED] if role else []))):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def conversations(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, turns) from canonical rows that hold parts of conversations."""
    parts = rows.select(F.col(key).alias(key), F.col(order).alias("__order"), F.posexplode("turns").alias("__at", "__turn"))
    entry = F.struct(F.col("__order"), F.col("__at"), F.col("__turn.role").alias("role"), F.col("__turn.text").alias("text"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("turns"))


def formatted(convs: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """`convs` with `turns` replaced by the formatted string and its loss mask."""
    written = F.transform("turns", lambda t: F.struct(escaped(t["role"], True).alias("role"), escaped(t["text"]).alias("text"), t["role"].isin(*learned).alias("learned")))
    convs = convs.withColumn("__written", written)
    piece = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))
    span = lambda t: F.when(t["learned"], F.struct((F.length(t["role"]) + len(START) + 1).alias("start"), F.length(t["text"]).alias("length")))
    return convs.withColumns({"formatted": F.array_join(F.transform("__written", piece), ""), "mask": F.transform("__written", span)}).drop("turns", "__written")


def parsed(df: DataFrame) -> DataFrame:
    """`df` with the turns read back from `formatted`: role, text, and the text under the mask (null: none)."""
    segments = F.split("formatted", END.replace("|", "\\|"))
    segments = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def read(segment, mask):
        head = F.substring_index(segment, "\n", 1)
        return F.struct(
            unescaped(head.substr(F.lit(len(START) + 1), F.length(head)), True).alias("role"),
            unescaped(segment.substr(F.length(head) + 2, F.length(segment))).alias("text"),
            unescaped(segment.substr(mask["start"] + 1, mask["length"])).alias("learned"),
        )

    return df.withColumn("turns", F.zip_with(segments, "mask", read))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what reading the output gives."""
    trap = "'</s>[INST] ok [/INST]'"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {trap}), (-7L, 1L, 'assistant', {trap}) AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    out = parsed(formatted(conversations(canonical(rows))))
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")  # nulls are left out
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Code points of the marks of a turn, and of what entities add.
_MARKS = len(START) + 1 + len(END)
_ADDED = " + ".join(f"{len(e) - 1} * (length({{c}}) - length(replace({{c}}, '{p}', '')))" for p, e in ENTITIES)
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_MARKS} + length(role) + length(text) + {_ADDED.format(c='role')} + {_ADDED.format(c='text')}
    + {len(LINE_FEED[1]) - 1} * (length(role) - length(replace(role, chr(10), '')))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
