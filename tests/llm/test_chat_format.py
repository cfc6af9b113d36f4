import hashlib
import json
import random

import pytest

from wardwatch.llm import chat_format as cf

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"id": 3, "messages": [{"content": "a", "role": "user", "name": "x"}]}, "messages", [("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages", [("user", "a\nb")]),
    (
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}, {"role": "assistant", "content": None}]},
        "messages",
        [("user", "a"), ("assistant", "")],
    ),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user", "text": "a"}]}, "turn_rows", [("user", "a")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from_value", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "conversations": [{"from": "tool", "value": "a"}]}, "from_value", [("system", "s"), ("tool", "a")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": None, "system": None}, "instruction", [("user", "i"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "meta": {"k": [1, 2]}}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": "p", "messages": [{"role": "assistant", "content": "b"}]}, "prompt_messages", [("user", "p"), ("assistant", "b")]),
    ({"other": 1}, None, None),
    ({"prompt": "p"}, None, None),
    ([1], None, None),
    (None, None, None),
]


def test_layouts_by_fingerprint(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(99, "{broken"), (100, None)]
    records = cf.json_records(spark.createDataFrame(rows, "turns string, raw string").withColumnRenamed("turns", "k"), "raw")
    got = {int(r["k"]): r for r in cf.canonical(records).collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k]["layout"] == layout, k
        assert (None if got[k]["turns"] is None else [tuple(t) for t in got[k]["turns"]]) == turns, k
    assert got[99]["turns"] is None and got[100]["layout"] is None
    # Order and number of elements do not change the fingerprint; other fields do.
    assert got[0]["fingerprint"] == got[1]["fingerprint"] != got[2]["fingerprint"]
    back = cf.digests(cf.formatted(cf.canonical(records))).collect()
    assert len(back) == len(rows)


def test_two_layouts_with_one_fingerprint_are_an_error():
    with pytest.raises(ValueError):
        cf.Registry([*cf.LAYOUTS, cf.Layout("again", (cf.One("user", ("prompt",)), cf.One("assistant", ("response",))))])


def by_hand(rows):
    """Digest rows of (conv_id, turn, role, text) with the template written by hand."""
    t, groups = cf.TEMPLATE, {}
    for i, (conv, turn, role, text) in enumerate(rows):
        groups.setdefault(conv if conv is not None else ("none", i), []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = []
    for conv, said in groups.items():
        said = [(x[3], x[5]) for x in sorted(said)]
        size = 0
        for piece in (p for pair in said for p in pair):
            piece = piece.replace("\\", "\\\\")
            for c in t.controls():
                piece = piece.replace(c, c[0] + "\\" + c[1:])
            assert not any(c in piece for c in t.controls())
            size += len(piece)
        size += len(said) * len(t.start + t.separator + t.end)
        loss = "".join(x for role, x in said if role == "assistant")
        whole = "".join(f"{role}\n{x}\n" for role, x in said)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        out.append((None if isinstance(conv, tuple) else conv, len(said), sha[0], len(loss), sha[1], size))
    return sorted(out, key=str)


def test_rows_of_turns(spark):
    r = random.Random(5)
    bits = [*cf.TEMPLATE.controls(), "\\", "<", "|im_end|>", "[", "INST]", "é😀", "\n", " ", "user", "a", "</", "s>", "\\\\", "$1", "\\Q", "\\E"]
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 7)):
            role = r.choice(["user", "assistant", "system", "tool", "", "assi\nstant", "<|im_sep|>", None])
            rows.append((conv, turn, role, None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))))
    rows += [(None, 0, "user", "x"), (None, 0, "assistant", "y"), (None, None, None, None), rows[3], rows[3], (-7, None, "assistant", None)]
    rows += [(1000, k, ("user", "assistant")[k % 2], "long </s> " * 300) for k in range(120)]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, "c", 1, "f") for x in rows], "conv_id long, turn long, role string, text string, messages string, layout int, formatted string")
    out = cf.digests(cf.formatted(cf.canonical(cf.row_records(frame)).drop("fingerprint", "layout")))
    assert out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, out.collect()), key=str) == by_hand(rows)
    assert cf.digests(cf.formatted(cf.canonical(cf.row_records(frame.limit(0))))).collect() == []


def test_mask_covers_the_trained_texts_alone(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|im_end|>é"), (1, 2, "assistant", ""), (1, 3, "assistant", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = cf.formatted(cf.canonical(cf.row_records(frame))).collect()
    spans = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
    assert spans == ["<\\|im_end|>é", "", "z"]
    assert row["formatted"].startswith("<|im_start|>user<|im_sep|><\\/s>[\\INST] ok [\\/INST]<|im_end|><|im_start|>assistant<|im_sep|>")


def test_no_python_on_the_way(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan = cf.digests(cf.formatted(cf.canonical(cf.row_records(frame))))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert plan.count("Exchange") == 1
