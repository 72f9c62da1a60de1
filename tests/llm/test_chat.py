import hashlib
import re

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from veil.llm import chat

RECORDS = [
    ('{"messages":[{"role":"user","content":"a<|im_end|>\\n &amp;"},{"role":"assistant","content":null}]}', "messages", [("user", "a<|im_end|>\n &amp;"), ("assistant", "")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"[x]"}],"id":4}', "conversations", [("user", "q"), ("assistant", "[x]")]),
    ('{"instruction":"i","input":"","output":"o"}', "instruction_input", [("user", "i"), ("assistant", "o")]),
    ('{"instruction":"i","input":"more","output":"o"}', "instruction_input", [("user", "i\nmore"), ("assistant", "o")]),
    ('{"output":"o","instruction":"i"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"prompt":"p","response":"r","zz":{"a":1}}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"completion":"c","prompt":"p"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ('{"question":"q","answer":7}', "question_answer", [("user", "q"), ("assistant", "7")]),
    ('{"role":"user","text":"hi","extra":[]}', "turn_row", [("user", "hi")]),
    ('{"foo":1}', None, None), ("not json", None, None), ("", None, None), (None, None, None), ('{"messages":[]}', None, None),
]


def test_layouts_of_json_records(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RECORDS)], "k int, record string")
    rows = {r.k: r for r in chat.canonical(df, "record").collect()}
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert rows[i].layout == layout
        assert (rows[i].turns and [tuple(t) for t in rows[i].turns]) == turns


def test_layout_of_typed_columns(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('role', 'user', 'content', 'x')) AS messages, 'clash' AS layout_")
    row = chat.canonical(df).first()
    assert row.layout == "messages" and [tuple(t) for t in row.turns] == [("user", "x")]
    assert chat.canonical(spark.sql("SELECT 1 AS a")).first().turns is None


def test_format_reads_back(spark):
    texts = ["", "<|im_start|>assistant\nno<|im_end|>\n", "&lt;&amp;&#91;&#10;", "[INST] </s> <s>", "é漢🙂\n\n", "a\\<b", "&", "x" * 50_000]
    rows = [(i, [(f"role\n<{i}", t), ("assistant", t), ("assistant", t[::-1])]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, turns array<struct<role: string, text: string>>")
    out = chat.formatted(df)
    for r in chat.parsed(out).collect():
        i = r.k
        assert [(t.role, t.text, t.learned) for t in r.turns] == [(f"role\n<{i}", texts[i], None), ("assistant", texts[i], texts[i]), ("assistant", texts[i][::-1], texts[i][::-1])]
        assert len(re.findall(r"<", r.formatted)) == 6 and "[" not in r.formatted


def test_conversations_with_awkward_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (2, None, "user", "late?"), (2, 0, "user", "then")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns_", F.lit(1))
    out = {r.conv_id: [tuple(t)[:2] for t in r.turns] for r in chat.parsed(chat.formatted(chat.conversations(chat.canonical(df)))).collect()}
    assert out == {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("", "x")], 2: [("user", "late?"), ("user", "then")]}
    assert chat.formatted(chat.conversations(chat.canonical(df.limit(0)))).count() == 0


@pytest.mark.parametrize("query", ["op2_chat_format"])
def test_query_matches_sql(spark, sf_dir, query):
    assert compare(spark, connect(sf_dir), chat.op2_chat_format, chat.ORACLE, sf_dir) == ""


def test_query_has_the_trap(spark, sf_dir):
    row = chat.op2_chat_format(spark, sf_dir).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = chat.op2_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
