import hashlib
import json
import random

import pytest

from lexigraph.llm import chat as C


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "[", "\\", "n", "|turn|>", "|end|>", "</s>", "[INST]", "[/INST]", "\n", "é🙂"]) for _ in range(rng.randrange(12)))
        out = C.escaped(text)
        assert C.unescaped(out) == text
        assert not any(s in out for s in ("<|", "</s>", "[INST]", "[/INST]", "<<"))


def test_turns_round_trip():
    rng = random.Random(2)
    bits = ["<|end|>", "<|turn|>", "\n", "\\n", "user", "[", "<", ""]
    for _ in range(2000):
        turns = [("".join(rng.choice(bits) for _ in range(3)), "".join(rng.choice(bits) for _ in range(4))) for _ in range(rng.randrange(5))]
        assert C.parsed(C.formatted(turns)[0]) == turns


LAYOUTS = [
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input_output", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": None, "output": "o"}, "instruction_input_output", [("user", "i"), ("assistant", "o")]),
    ({"system": "s", "question": "q", "answer": "a"}, "question_answer_system", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "u"}, {"content": "a", "role": "assistant"}]}, "messages_role", [("user", "u"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}, "conversations_from", [("user", "u"), ("assistant", "a")]),
    ([{"role": "user", "content": "u"}], "list_role", [("user", "u")]),
    ({"messages": []}, "messages_role_empty", []),
    ({"unknown": 1}, None, []),
    ({"prompt": "p", "response": "r", "score": 3}, None, []),
    ({"id": 4, "metadata": {"a": [1], "b": None}, "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
]


@pytest.mark.parametrize("record,layout,turns", LAYOUTS)
def test_layouts(record, layout, turns):
    by_print = {C.fingerprint(m.paths): m for m in C.MAPPINGS}
    found = C.canonical(json.dumps(record), by_print)
    assert (found[0], found[2]) == (layout, turns)


def test_records_of_mixed_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)] + [(90, None), (None, "no json"), (91, "")]
    found = {r.conv_id: r for r in C.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert len(found) == len(rows)
    for i, (_, layout, turns) in enumerate(LAYOUTS):
        assert found[i].layout == layout and [tuple(t) for t in found[i].turns] == turns
    assert found[90].layout is None and found[None].turns == [] and found[91].formatted == ""


def test_conversations_with_nulls_ties_and_control_strings(spark):
    rows = [
        (1, 2, "assistant", "b<|end|>"), (1, 1, "user", None), (1, 2, "assistant", "b<|end|>"), (1, 3, None, "\\n[INST]"),
        (2, 1, "assistant", ""), (None, 1, "user", "x" * 100_000), (3, None, "assistant", "é🙂"), (3, 1, "assistant", "z"),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, record string")
    found = {r.conv_id: r for r in C.read_back(C.format_records(C.shaped_records(frame))).collect()}
    want = {
        1: [("user", ""), ("assistant", "b<|end|>"), ("assistant", "b<|end|>"), ("", "\\n[INST]")],
        2: [("assistant", "")], None: [("user", "x" * 100_000)], 3: [("assistant", "é🙂"), ("assistant", "z")],
    }
    assert set(found) == set(want)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (found[k].n_turns, found[k].loss_chars) == (len(turns), len(loss))
        assert found[k].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and found[k].loss_sha256 == sha(loss)
    assert C.read_back(C.format_records(C.shaped_records(frame.limit(0)))).count() == 0


def test_conversations_take_many_layouts_and_keep_their_turns(spark):
    shapes = {
        "prompt_response": ["user", "assistant"], "instruction_output_system": ["system", "user", "assistant"],
        "conversations_from_system": ["system", "user", "assistant", "user"], "list_role": ["user", "assistant", "user"],
        "turns_speaker": ["user", "assistant"] * 2, "conversations_from": ["user", "assistant", "system", "user", "user", "assistant"],
        "messages_role": ["user", "human", "gpt"],
    }
    odd = ["", "a<|end|>", "é🙂\n", '{"x": [1]}', "\\n"]
    said = {i: [(r, odd[(i + k) % 5] if i else "") for k, r in enumerate(roles)] for i, roles in enumerate(shapes.values())}
    rows = [(i, k, r, t or None) for i, turns in said.items() for k, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r.conv_id: r for r in C.format_records(C.shaped_records(frame)).collect()}
    assert {i: found[i].layout for i in found} == dict(enumerate(shapes))
    assert {i: [tuple(t) for t in found[i].turns] for i in found} == said


def test_query_against_its_oracle(spark):
    import duckdb

    db = duckdb.connect()
    db.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    found = C.op7_chat_format(spark, "/root/testdata/sf0.01")
    columns = sorted(found.columns)
    want = db.sql(f"select {', '.join(columns)} from ({C.ORACLE})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want)
    assert len({r[columns.index("layout")] for r in want}) > 2
