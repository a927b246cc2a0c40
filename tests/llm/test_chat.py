"""Chat formatting: layouts, escapes, masks and exact reading back."""

import hashlib

from pyspark.sql import functions as F

from arcweft.llm import chat

ODD = ["", "</s>[INST] ok [/INST]", "<turn>user<text>x<end>", "&lt;&amp;lsqb;", "a\nb\r\n", "é😀<", "[[&&<<", "&amp;lt;"]


def test_all_layouts(spark):
    turn = "array<struct<role:string,content:string>>"
    schema = f"id int, messages {turn}, conversations array<struct<from:string,value:string>>, turns array<struct<role:string,text:string>>, prompt string, completion string, response string, instruction string, input string, output string, system string, unknown string"
    none = dict.fromkeys(["messages", "conversations", "turns", "prompt", "completion", "response", "instruction", "input", "output", "system", "unknown"])
    rows = [
        ({"messages": [("user", "a"), ("assistant", "b")]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [("assistant", None)]}, "conversations", [("assistant", "")]),
        ({"turns": [(None, "x")]}, "turns", [("", "x")]),
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": "c", "unknown": "u"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "completion": "c"}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ]
    df = spark.createDataFrame([(i, *{**none, **r}.values()) for i, (r, _, _) in enumerate(rows)], schema)
    got = {r.id: r for r in chat.canonical(df, ["id"]).collect()}
    for i, (_, layout, turns) in enumerate(rows):
        assert got[i].layout == layout and [tuple(t) for t in got[i].turns] == turns
    assert len({r.fingerprint for r in got.values()}) == len(rows)


def test_other_fields_and_nulls_do_not_matter(spark):
    turn = "array<struct<role:string,content:string,name:string,extra:struct<x:int>>>"
    df = spark.createDataFrame(
        [(1, [("user", "a", "Ann", (1,)), ("assistant", "b", None, None)], "be kind", "x", None, None), (2, [("user", None, None, None)], None, None, None, None), (3, None, None, None, None, "c"), (4, None, None, None, None, None), (5, [], "s", None, "p", "c"), (6, [None], None, "x", None, None)],
        f"id int, messages {turn}, system string, input string, prompt string, completion string",
    )
    got = {r.id: (r.layout, [tuple(t) for t in r.turns]) for r in chat.canonical(df, ["id"]).collect()}
    assert got == {
        1: ("messages", [("user", "a"), ("assistant", "b")]),
        2: ("messages", [("user", "")]),
        3: ("prompt", [("user", ""), ("assistant", "c")]),
        4: (None, []),
        5: ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        6: (None, []),
    }
    prints = {r.id: r.fingerprint for r in chat.canonical(df, ["id"]).collect()}
    assert prints[1] == hashlib.sha256(b"messages[].content\nmessages[].role").hexdigest() and prints[4] == prints[6] != prints[2]
    assert [r.formatted for r in chat.format_turns(chat.canonical(df.where("id = 4"), ["id"])).collect()] == [""]
    assert chat.canonical(df.select("id", "input"), ["id"]).where("layout is null and size(turns) = 0").count() == 6


def test_round_trip_of_control_strings(spark):
    turns = [[("user", t), ("assistant", t), ("<role>", t)] for t in ODD] + [[], [("assistant", "x" * 200_000)] * 2]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], "id int, turns array<struct<role:string,text:string>>")
    for r in chat.read_back(chat.format_turns(df)).collect():
        assert [tuple(t) for t in r.turns] == turns[r.id]
        assert r.loss_text == "".join(t for role, t in turns[r.id] if role == "assistant")
        assert r.formatted.count("<turn>") == len(turns[r.id]) and "[INST]" not in r.formatted


def test_query_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 0, "user", "n"), (3, None, None, None), (4, 0, "user", "t"), (4, 0, "user", "t"), (4, 0, "assistant", "t"), (None, 1, "user", "m")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.op8_chat_formatting(spark, df).collect()}
    assert sum(r.conv_id is None and r.n_turns == 1 for r in chat.op8_chat_formatting(spark, df).collect()) == 2
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None, 3, 4, -7}
    assert (got[1].turns_sha256, got[1].loss_sha256, got[1].loss_chars) == (sha("user\na\nassistant\nb\n"), sha("b"), 1)
    assert got[4].n_turns == 3 and got[4].turns_sha256 == sha("assistant\nt\nuser\nt\nuser\nt\n")
    said = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-7].loss_sha256 == sha(said) and got[-7].loss_chars == len(said)
    assert got[-7].layout == "prompt" and got[1].layout == "messages"
    assert [r.conv_id for r in chat.op8_chat_formatting(spark, df.filter(F.lit(False))).collect()] == [-7]
