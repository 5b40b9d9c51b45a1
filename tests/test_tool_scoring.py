import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tuneframe.functions import toolcalls
from tuneframe.operators import scoring

K1 = [("f", '{"k": 1}')]
# name, prediction, gold steps, (strict, parse, name); None = not fixed
VECTORS = [
    ("key order", 'I need a seat.\nAction: book_seat\nAction Input: {"row": 12, "train": "night", "window": true}',
     [("book_seat", '{"train": "night", "window": true, "row": 12}')], (1, 1, 1)),
    ("order of calls", 'Action: b\nAction Input: {"x": 2}\nAction: a\nAction Input: {"x": 1}',
     [("a", '{"x": 1}'), ("b", '{"x": 2}')], (0, None, 0)),
    ("broken json", "Action: ping\nAction Input: {broken", [("ping", '{"ok": 1}')], (0, 0, None)),
    ("fenced", 'Action: convert\nAction Input: ```json\n{\n  "from": "mile",\n  "amount": 7\n}\n```',
     [("convert", '{"amount": 7, "from": "mile"}')], (1, 1, None)),
    ("int float", 'Action: f\nAction Input: {"k": 1.0}', K1, (1, 1, 1)),
    ("int true", 'Action: f\nAction Input: {"k": true}', K1, (1, 1, 1)),
    ("exponent", 'Action: f\nAction Input: {"k": 1e0}', K1, (1, 1, 1)),
    ("string int", 'Action: f\nAction Input: {"k": "1"}', K1, (0, 1, 1)),
    ("literal", "Action: f\nAction Input: {'k': 1}", K1, (1, 1, 1)),
    ("duplicate key", 'Action: f\nAction Input: {"k": 2, "k": 1}', K1, (1, 1, 1)),
    ("other case", 'action : f\nACTION INPUT : {"k": 1}', K1, (1, 1, 1)),
    ("space in name", 'Action:  f \nAction Input:{"k":1}', K1, (1, 1, 1)),
    ("overwrite pending", 'Action: g\nAction: f\nAction Input: {"k": 1}', K1, (1, 1, 1)),
    ("input before action", 'Action Input: {"k": 9}\nAction: f\nAction Input: {"k": 1}', K1, (1, 1, 1)),
    ("trailing action", 'Action: f\nAction Input: {"k": 1}\nAction: g', K1, (1, 0, 1)),
    ("multi-line", 'Action: f\nAction Input: {\n"k": 1\n}', K1, (1, 1, 1)),
    ("brace in string", 'Action: f\nAction Input: {"k": "}"}', [("f", '{"k": "}"}')], (1, 1, 1)),
    ("open brace swallows", 'Action: f\nAction Input: {"k": "{"}\nAction: g\nAction Input: {"k": 2}',
     [("f", '{"k": "{"}'), ("g", '{"k": 2}')], (0, 0, 0)),
    ("same raw text", "Action: f\nAction Input: hello", [("f", "hello")], (1, 0, 1)),
    ("parsed string equals raw text", 'Action: f\nAction Input: "hello"', [("f", "hello")], (1, 1, 1)),
    ("empty payload", "Action: f\nAction Input:", [("f", "")], (1, 0, 1)),
    ("no call", "nothing", K1, (0, 0, 0)),
    ("no call, empty gold", "nothing", [], (1, 0, 1)),
    ("blank name", 'Action:  \nAction Input: {"k": 1}', [("", '{"k": 1}')], (1, 1, 1)),
    ("bare action", 'Action:\nAction Input: {"k": 1}', K1, (0, 0, 0)),
    ("fence unterminated", 'Action: f\nAction Input: ```json\n{"k": 1}', K1, (0, 0, 1)),
    ("tuple list", 'Action: f\nAction Input: {"k": (1, 2)}', [("f", '{"k": [1, 2]}')], (1, 1, 1)),
    ("nan", 'Action: f\nAction Input: {"k": NaN}', [("f", '{"k": NaN}')], (1, 1, 1)),
    ("case of name", 'Action: F\nAction Input: {"k": 1}', K1, (0, 1, 0)),
    ("mixed keys unreadable", "Action: f\nAction Input: {1: 2, 'a': 3}", [("f", "{1: 2, 'a': 3}")], (1, 0, 1)),
    ("big integers differ", 'Action: f\nAction Input: {"k": 100000000000000000000000000000000000000001}',
     [("f", '{"k": 100000000000000000000000000000000000000002}')], (0, 1, 1)),
]


@pytest.mark.parametrize("parsed_first", [True, False])
def test_vectors(rows, parsed_first):
    df = rows(
        "example_id int, prediction string, golden_answer array<struct<Action:string,Action_Input:string>>",
        [(i, p, gold) for i, (_, p, gold, _) in enumerate(VECTORS)],
    )
    scored = scoring.score_tool(scoring.parse_gold(scoring.with_calls(df, engine="variant"), engine="variant") if parsed_first else df)
    for row in scored.collect():
        name, _, _, want = VECTORS[row["example_id"]]
        got = (row["strict_match"], row["parse_success"], row["action_name_match"])
        assert all(w is None or g == w for g, w in zip(got, want)), (name, got, want)


def test_missing_gold_fields_read_none(rows):
    df = rows(
        "prediction string, golden_answer array<struct<Action:string,Action_Input:string>>",
        [("Action: None\nAction Input: None", [(None, None)])],
    )
    assert scoring.score_tool(df).first()["strict_match"] == 1.0


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from([0.0, 1.0, -0.0, 0.5, 1e22, 1e300]) | st.text("ab1", max_size=2),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("ab", max_size=1), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=400, deadline=None)
@given(VALUES, VALUES)
def test_keys_agree_with_python_equality(a, b):
    assert (toolcalls._key(a) == toolcalls._key(b)) == (a == b)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_json_and_literal_forms_have_one_key(value):
    assert toolcalls._argument(json.dumps(value)) == toolcalls._argument(repr(value)) == (toolcalls._key(value), True)


PLAIN = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.sampled_from([0, -1, 15, 255]) | st.text(st.characters(codec="utf-8"), max_size=4),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text('ab"\\\\ü', max_size=2), inner, max_size=3),
    max_leaves=8,
)
ARGUMENTS = [
    "", " ", "5", "-0", "1.0", "1e0", "1.5", "true", "null", "nan", "NaN", '"x"', '"\\u0041"', '"\\ud83d\\ude00"', '"\\ud800"', "{}", "[]", "[[]]", "[1,]", "[1 2]",
    '{"a":1} x', '{"a":1}]', '{"a":1},5', "1],[2", "1,2", '{"a":1}{"b":2}', '{"a":1,"a":2}', "{'a':1}", '{"b":1,"a":[true,null,{"c":"d"}]}', "[[[[1]]]]", "[[[1]]]",
    "9223372036854775807", "9223372036854775808", "-9223372036854775808", "123456789012345678901234567890", "01", "+1", "tab\there", '"a\nb"', '"é"', " {\"a\" : 1 } ", "{1: 2}", "]", "[", '"', '\\"',
    '{"":""}', '{"a":{"b":{"c":{"d":1}}}}', "0x10", "1_000", "[0]", "0],0", '"a",0],["b"',
]


def test_plain_keys_agree_with_the_other_form(rows):
    fuzz = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(PLAIN, st.booleans())
    def collect(value, ascii_only):
        fuzz.append(json.dumps(value, ensure_ascii=ascii_only))

    collect()
    texts = ARGUMENTS + fuzz
    df = rows("i int, t string", list(enumerate(texts))).select("i", toolcalls.plain_key(F.btrim("t")).alias("k"))
    plain = 0
    for r in df.collect():
        key, readable = toolcalls._argument(texts[r["i"]])
        assert r["k"] is None or (r["k"] == key and readable), (texts[r["i"]], r["k"], key)
        plain += r["k"] is not None
    assert plain > 150  # the usual kinds do not need Python


PARTS = ["Action: f", "action :  g  h ", "Action Input: {\"k\": 1}", "ACTION INPUT:[1, {\"a\": \"}\"}]", "Action Input: {\"k\": \"{\"}", "Action Input: hello", "Action Input: ",
         "Action:", "Action:  ", "text", "}", "", "  Action: t\tx", "Action Input: 1.5", "Action Input: {'k': 1}", "```", "Action Input: ```json", "Actions: no", "Action\tInput: 2", "ActionInput : 3", "\r", "é"]


def test_plain_predictions_agree_with_the_other_form(rows):
    rng = random.Random(3)
    texts = [p for _, p, _, _ in VECTORS] + ["\n".join(rng.choices(PARTS, k=rng.randrange(0, 7))) for _ in range(1500)]
    df = toolcalls.with_parsed_calls(rows("i int, prediction string", list(enumerate(texts))), engine="variant")
    df = df.withColumn("plain", toolcalls.plain_calls(F.col("prediction")))
    n = 0
    for r in df.collect():
        want = toolcalls.parse_calls(texts[r["i"]])
        assert r["calls"].asDict(True) == want, texts[r["i"]]
        n += r["plain"] is not None
    assert n > 200


def test_routes(rows):
    data = [("a", "Action: f\nAction Input: {}"), ("a", "Action: f\nAction Input: 1.5"), ("b", None), ("b", "Action: f\nAction Input: {\n}")]
    got = {r["run"]: (r["n"], r["n_python"]) for r in scoring.argument_routes(rows("run string, prediction string", data), ["run"]).collect()}
    assert got == {"a": (2, 1), "b": (2, 1)}


def test_special_numbers():
    assert toolcalls._key(math.inf) != toolcalls._key(-math.inf) != toolcalls._key(math.nan)
    assert toolcalls._key(2 + 0j) == toolcalls._key(2) != toolcalls._key(2 + 1j)
    assert toolcalls._key({(1, 2), (3,)}) == toolcalls._key({(3,), (1, 2)})
