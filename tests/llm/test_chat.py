"""Chats: layouts by fingerprint, templates read back, loss masks."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat as C

ODD = ["<|t5_x-1|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>\n", "<|im_start|>", "\\", "<", "[", "a", "é", "\n", "s>", "INST]", "|im_end|>", "%", "%0A", "🙂", "<<SYS>>"]


def texts(n=150):
    rng = random.Random(7)
    return ["", *("".join(rng.choices(ODD, k=rng.randint(0, 12))) for _ in range(n))]


def test_escapes_are_reversible_and_hide_controls(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", C.escape(F.col("t")).alias("e")).withColumn("u", C.unescape(F.col("e"))).collect()
    assert all(r["u"] == r["t"] for r in rows)
    assert not any(x in r["e"] for r in rows for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>"))


def test_chats_are_read_back(spark):
    rng = random.Random(8)
    pool = texts()
    chats = {i: [(t, rng.choice(["user", "assistant", "a\nb%", "<|im_end|>\n", ""]), rng.choice(pool)) for t in range(rng.randint(1, 9))] for i in range(60)}
    chats[99] = [(0, None, None), (0, "assistant", "x"), (0, "assistant", "x")]
    rows = [(i, t, r, x) for i, turns in chats.items() for t, r, x in turns]
    made = C.format_turns(spark.createDataFrame(rows, "id long, turn long, role string, text string"))
    got = made.select("id", "formatted", "loss", C.parse(F.col("formatted")).alias("turns"), C.trained_text(F.col("formatted"), F.col("loss")).alias("trained")).collect()
    assert len(got) == len(chats)
    for r in got:
        turns = sorted((t, a or "", x or "") for t, a, x in chats[r["id"]])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(a, x) for _, a, x in turns]
        assert r["trained"] == "".join(x for _, a, x in turns if a == "assistant")
        assert len(r["loss"]) == sum(a == "assistant" for _, a, _ in turns)


RECORDS = [
    ({"messages": [{"role": "human", "content": "q"}, {"content": "a", "role": "gpt"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": "q"}]}, "conversations", [("system", "s"), ("user", "q")]),
    ({"output": "o", "instruction": "i", "input": ""}, "instruction_input", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": None}, "instruction_input", [("user", "i\n\nn"), ("assistant", "")]),
    ({"prompt": "p", "response": "r", "system": None}, "system_prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 4}, "question_answer", [("user", "q"), ("assistant", "4")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"id": "7", "conversations": [{"from": "human", "value": "q"}]}, "conversations", [("user", "q")]),
    ({"messages": [{"role": "user", "content": "q", "meta": {"a": [{"b": 1}]}}], "odd.name: <x>": {"deep": [[1]]}}, "messages", [("user", "q")]),
    ({"messages": [{"role": "user", "text": "q"}, {"role": "bot", "text": "a", "score": 0.5}], "prompt": "p"}, "messages_text", [("user", "q"), ("assistant", "a")]),
    ({"messages": []}, "messages", [(None, None)]),
    ({"prompt": "p", "response": "r", "messages": []}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "n", "output": "o", "prompt": "x"}, "instruction_input", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"prompt": "[]", "completion": '[{"role": "x"}]'}, "prompt_completion", [("user", "[]"), ("assistant", '[{"role": "x"}]')]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, "system_messages", [("system", "s"), ("user", "q")]),
    ({"conversations": [{"from": "gpt", "value": "a"}], "system": "s"}, "system_conversations", [("system", "s"), ("assistant", "a")]),
    ({"conversations": [{"from": "gpt", "value": "a"}], "system": None}, "system_conversations", [("assistant", "a")]),
    ({"system": "s", "messages": []}, "system_messages", [("system", "s")]),
    ({"system": "s", "prompt": "p", "completion": "c"}, "system_prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "output": "o", "system": "s"}, "system_instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o", "system": "s"}, "system_instruction_input", [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
    ({"messages": [{"from": "human", "content": "q"}]}, "messages_from", [("user", "q")]),
    ({"messages": [{"from": "human", "value": "q"}], "system": "s"}, "system_messages_value", [("system", "s"), ("user", "q")]),
    ({"input": "n", "output": "o"}, "input_output", [("user", "n"), ("assistant", "o")]),
    ({"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]}, "prompt_completion_lists", [("user", "q"), ("assistant", "a")]),
    ({"prompt": '[{"role": "user", "content": "q"}]', "completion": "c"}, "prompt_completion", [("user", '[{"role": "user", "content": "q"}]'), ("assistant", "c")]),
    ({"messages": [1, 2]}, None, [(None, None)]),
    ({"foo": 1}, None, [(None, None)]),
    ([1], None, [(None, None)]),
]


@pytest.mark.parametrize("record, layout, turns", RECORDS)
def test_layouts_of_json_rows(spark, record, layout, turns):
    got = C.to_turns(spark.createDataFrame([(1, json.dumps(record))], "id int, r string"), "id", "r").orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in got] == turns and {r["layout"] for r in got} == {layout}


def test_fingerprints_ignore_order_and_match_types(spark):
    for x in C.LAYOUTS:
        assert x.fingerprint == C.fingerprint_of(reversed(x.paths)) == C.fingerprint_of(C.paths_of(C._shape(x)))
    assert len({x.fingerprint for x in C.LAYOUTS}) == len(C.LAYOUTS)
    rows = spark.createDataFrame([("{",), (None,), ("3",), ("{}",)], "r string").select(C.json_fingerprint(C.json_parts(F.col("r"), C._lists(C.LAYOUTS))).alias("f")).collect()
    assert [r["f"] for r in rows] == [None] * 4


def test_typed_records_and_empty_tables(spark):
    made = spark.sql("SELECT 1 AS id, named_struct('messages', array(named_struct('role', 'user', 'content', 'q'))) AS r UNION ALL SELECT 2, NULL")
    got = C.to_turns(made, "id", "r").orderBy("id").collect()
    assert [(r["id"], r["turn"], r["text"]) for r in got] == [(1, 0, "q"), (2, None, None)]
    assert C.format_turns(C.to_turns(made.limit(0), "id", "r")).count() == 0
    assert C.to_turns(spark.sql("SELECT 1 AS id, named_struct('odd', 1) AS r"), "id", "r").first()["layout"] is None
    blank = C.format_turns(C.to_turns(spark.createDataFrame([(5, None)], "id int, r string"), "id", "r")).first()
    assert (blank["formatted"], blank["loss"]) == ("", [])


def test_query_digests(spark):
    got = {r["conv_id"]: r for r in C.op5_chat(spark, "/root/testdata/sf0.001").collect()}
    odd = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(odd) and got[-1]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def test_query_on_odd_conversations(spark, tmp_path):
    """Null turns, roles that layouts would rename, nulls, repeated rows and a very long text, held against the query's SQL."""
    import duckdb

    from lodestone.llm.chat import OP5_SQL

    long = "text <|im_end|>\n[INST] é " * 20_000
    rows = [(1, None, "user", "lost?"), (1, 0, "bot", "a"), (1, 0, "bot", "a"), (1, 1, "gpt", ""), (1, 2, "assistant", "b"), (2, None, None, None), (2, None, "human", None), (3, 5, "assistant", long), (3, 6, "system", long), (4, 0, "model", "<s>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.op5_chat(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(OP5_SQL)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())
    turns = {r["conv_id"]: r["n_turns"] for r in got.collect()}
    assert turns == {-1: 2, 1: 5, 2: 2, 3: 2, 4: 1}
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert C.op5_chat(spark, f"{tmp_path}/none").count() == 1


def test_a_typed_record_with_a_system_text(spark):
    made = spark.sql("SELECT 1 AS id, named_struct('system', 's', 'messages', array(named_struct('role', 'user', 'content', 'q'))) AS r")
    assert [(r["role"], r["text"]) for r in C.to_turns(made, "id", "r").orderBy("turn").collect()] == [("system", "s"), ("user", "q")]
