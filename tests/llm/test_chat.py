import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowmill.llm import chat

NASTY = st.lists(st.sampled_from(list("\\<|n>a\n \t_éim") + ["<|im_end|>", "<|im_start|>", "\\\\", "<\\|"]), max_size=12).map("".join)


def round_trip(spark, conversations):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(conversations)], "id int, turns array<struct<role:string,text:string>>")
    made = df.select("id", "turns", chat.format_turns(F.col("turns")).alias("x")).select("id", "turns", "x.*")
    out = made.select("id", "turns", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return out.orderBy("id").collect()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "<|x", "\\n"]), NASTY), max_size=5), min_size=1, max_size=30))
def test_reading_back_is_exact(spark, conversations):
    for r, turns in zip(round_trip(spark, conversations), conversations, strict=True):
        assert [(t["role"], t["text"]) for t in r["back"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(turns)
        starts = [0]
        for p in r["formatted"].split("<|im_start|>")[1:]:
            starts.append(starts[-1] + len("<|im_start|>" + p))
        for s, span, (role, text) in zip(starts, r["loss_mask"], turns):
            assert (span is not None) == (role == "assistant")
            if span is not None:
                assert r["formatted"][s + span["start"] :][: span["length"]] == text.replace("\\", "\\\\").replace("<|", "<\\|")


def test_layouts_of_json(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"dialogue": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]}, {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
        {"instruction": "q", "input": None, "output": "a"}, {"messages": []}, {"messages": [{"role": None, "content": None}]}, {"other": 1}, {},
    ]
    texts = [*map(json.dumps, records), "not json", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["x"] for r in df.select("k", chat.turns_from_json(F.col("t")).alias("x")).orderBy("k").collect()]
    for r in got[:8]:
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
    assert [r["layout"] for r in got[:8]] == ["messages", "conversations", "dialogue", "instruction", "prompt", "response", "question", "instruction"]
    assert got[8]["turns"] == [] and [(t["role"], t["text"]) for t in got[9]["turns"]] == [("", "")]
    assert all(r is None or r["turns"] is None for r in got[10:])


def test_layouts_of_columns(spark):
    df = spark.createDataFrame([([("human", "q"), ("gpt", None)], 1), (None, 2)], "conversations array<struct<from:string,value:string>>, extra int")
    assert chat.layout_of(df).name == "conversations"
    assert [[tuple(t) for t in r[0]] for r in df.select(chat.turns_of(df)).collect()] == [[("user", "q"), ("assistant", "")], []]
    parts = spark.createDataFrame([("s", "q", "a"), (None, "q", None)], "system string, prompt string, completion string")
    assert [[t["role"] for t in r[0]] for r in parts.select(chat.turns_of(parts)).collect()] == [["system", "user", "assistant"], ["user"]]
    with pytest.raises(ValueError, match="layout"):
        chat.layout_of(df.select("extra"))
    a, b = spark.createDataFrame([], "b int, a struct<y:int,x:array<struct<z:int>>>"), ["a.x[].z", "a.y", "b"]
    assert sorted(chat.schema_paths(a.schema)) == b and chat.fingerprint(b) == chat.fingerprint(reversed(b))


def test_rows_by_turn(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, None, None, "first"), (None, 1, "user", "x"), (None, 1, "user", "x"), (2, 1, "user", "t"), (2, 1, "assistant", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_from_rows(df).collect()}
    assert got == {1: [("", "first"), ("user", ""), ("assistant", "b")], None: [("user", "x"), ("user", "x")], 2: [("assistant", "t"), ("user", "t")]}
    assert chat.turns_from_rows(df.limit(0)).count() == 0


def test_query_equals_sql_and_is_native(spark):
    from flowmill.llm.queries import OP2_SQL, op2_chat_format
    from tests.oracle import compare

    compare(spark, "/root/testdata/sf0.001", op2_chat_format, OP2_SQL)
    plan = op2_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    row = op2_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert row["loss_sha256"] == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()


def test_a_long_conversation(spark):
    df = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('text <| ', id) text")
    made = chat.turns_from_rows(df).select(chat.format_turns(F.col("turns")).alias("x")).select("x.*")
    loss = made.select(chat.read_loss(F.col("formatted"), F.col("loss_mask"))).first()[0]
    assert loss == "".join(f"text <| {k}" for k in range(1, 20_000, 2))


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ('{"id": 7, "messages": [{"role": "user", "content": "a", "weight": 1}, {"role": "assistant", "content": null}]}', "messages", [("user", "a"), ("assistant", "")]),
        ('{"messages": [], "id": {"x": [1]}}', "messages", []),
        ('{"messages": [{"role": "user", "content": [{"type": "text"}]}]}', None, None),
        ('{"messages": ["a", {"role": "user", "content": "b"}]}', None, None),
        ('{"messages": "a"}', None, None),
        ('{"meta": 1, "instruction": "do", "output": "done"}', "instruction", [("user", "do"), ("assistant", "done")]),
        ('{"prompt": "p", "response": 5, "tags": ["x"]}', "response", [("user", "p"), ("assistant", "5")]),
        ('{"prompt": ["p"], "response": "r"}', None, None),
        ('{"prompt": "p", "response": "r", "completion": "c"}', None, None),
        ("{}", None, None), ("[1]", None, None), ("no json", None, None), (None, None, None),
    ],
)
def test_json_fields_that_no_layout_names(spark, record, layout, turns):
    got = spark.createDataFrame([(record,)], "r string").select(chat.turns_from_json(F.col("r")).alias("x")).first()["x"]
    found = (None, None) if got is None else (got["layout"], got["turns"] and [tuple(t) for t in got["turns"]])
    assert found == (layout, turns) or (turns == [] and found == (layout, []))


def test_typed_turns_with_more_fields(spark):
    df = spark.createDataFrame([(1, [("user", "a", 0.5)])], "id long, messages array<struct<role:string,content:string,weight:double>>")
    assert chat.layout_of(df).name == "messages"
    assert [tuple(t) for t in df.select(chat.turns_of(df).alias("t")).first()["t"]] == [("user", "a")]
