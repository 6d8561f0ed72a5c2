"""op7: layouts by fingerprint in one table, records with other fields, keys and columns of any name."""

import json

from lexiloom.llm import chat

UA = [("user", "q"), ("assistant", "a")]


def turns(rows):
    return {r[0]: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None) for r in rows}


def test_other_fields_do_not_matter(spark):
    cases = [
        ({"id": 1, "source": "x, y: OBJECT<z>", "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "tools": [1]}]}, "messages"),
        ({"prompt": "q", "completion": "a", "meta": {"prompt": 1}}, "prompt_completion"),
        ({"prompt": "q", "response": "a", "score": None}, "prompt_response"),
        ([{"role": "user", "content": "q", "id": 7}, {"role": "assistant", "content": "a"}], "bare"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "model", "value": "a", "weight": 1}]}, "share"),
        ({"messages": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}], "system": "s"}, "messages_text"),
        ({"messages": []}, None), ({"messages": "none"}, None), (7, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0]), "kept", "gone") for i, c in enumerate(cases)], "i int, j string, _v string, turns string")
    out = chat.canonical_json(df, "j")
    assert {"_v", "turns", "layout", "fingerprint"} <= set(out.columns) and out.filter("_v = 'kept'").count() == len(cases)
    assert turns(out.collect()) == {i: (name, UA if name else None) for i, (_, name) in enumerate(cases)}


def test_a_table_of_several_layouts(spark):
    rows = [
        (1, [("user", "q"), ("assistant", "a")], None, None, None, None, "x"), (2, None, "q", "a", None, None, None), (3, None, None, None, "q", "a", "y"),
        (4, None, "q", None, None, None, None), (5, None, None, None, None, None, None), (None, None, "q", "a", None, None, None), (6, [], None, None, None, None, None),
    ]
    kinds = "id long, messages array<struct<role:string,content:string>>, prompt string, completion string, instruction string, output string, turns string"
    out = chat.canonical_records(spark.createDataFrame(rows, kinds), "id")
    want = {1: ("messages", UA), 2: ("prompt_completion", UA), 3: ("instruction", UA), 4: (None, None), 5: (None, None), None: ("prompt_completion", UA), 6: ("messages", [])}
    assert turns(out.collect()) == want
    assert {r.fingerprint for r in out.collect()} == {None, *(chat.fingerprint(x.paths) for x in chat.LAYOUTS if x.name in ("messages", "prompt_completion", "instruction"))}


def test_packing_loses_nothing(spark):
    long = "word </turn> \\b <x> " * 100_000
    rows = [(i, t, r, f"{i} {t} é😀") for i in range(40) for t, r in enumerate(("user", "assistant", "tool", "human")[: 1 + i % 4])] + [(99, 0, "user", long), (99, 1, "assistant", long), (98, 0, "model", None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "talk long, turn long, role string, text string, layout string")
    got = chat.canonical_records(chat.packed(chat.canonical_rows(df, "talk"), "talk"), "talk")
    assert {r.layout for r in got.collect()} == {"messages", "share", "prompt_completion", "instruction"}
    back = {r.talk: [tuple(t) for t in r.read_turns] for r in chat.parsed(chat.formatted(got)).collect()}
    want = {}
    for i, t, r, x in sorted(rows):
        want.setdefault(i, []).append((r, x or ""))
    assert back == want
