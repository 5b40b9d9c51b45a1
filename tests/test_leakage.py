import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tuneframe.operators import leakage

ROWS = "id bigint, prompt string, completion string, teacher_prompt string"


def flags(rows, prompt, completion, teacher="t"):
    row = leakage.flag_leaks(rows(ROWS, [(1, prompt, completion, teacher)])).first()
    return {name for name in leakage.DETECTORS if row[name]}


@pytest.mark.parametrize(
    "prompt, completion, teacher, want",
    [
        ("Prompt\nReasoning...\nFinal Label: choice1", "Reasoning...\nFinal Label: choice1", "t", {"completion_block"}),
        ("Final Label: True OR Final Label: False", "Final Label: True", "t", set()),
        ("a\n\n  b  \r\nc", "b\nc", "t", {"completion_block"}),
        ("a\nb\nc", "a\nc", "t", set()),
        ("ab\nc", "b\nc", "t", set()),
        ("x", "", "t", set()),
        ("x", " \n ", "t", set()),
        ("x", None, None, set()),
        ("x", "y", "  x\n", {"teacher_equal"}),
        (" x", "y", " x", set()),
        ("", "y", "  ", set()),
        ("The CORRECT label is: b", "y", "t", {"marker"}),
        ("Reference for this example:\nThe correct tool call is:", "y", "t", {"marker"}),
        ("one two", "two", "t", {"completion_block"}),
    ],
)
def test_detectors(rows, prompt, completion, teacher, want):
    assert flags(rows, prompt, completion, teacher) == want


def test_report_and_error(rows):
    df = rows(ROWS, [(i, "the correct label is: x", "c", "t") for i in range(25)] + [(100, "p", "p", "p")])
    report = {r["detector"]: (r["n"], r["first_ids"]) for r in leakage.leak_report(df, "id").collect()}
    assert report == {"marker": (25, list(range(10))), "completion_block": (1, [100]), "teacher_equal": (1, [100])}
    with pytest.raises(ValueError, match=r"leakage in evaluation rows: .*own completion.*\[100\]; .*used as prompt.*; .*marker.*\[0, 1, 2"):
        leakage.assert_no_leaks(df, "id")
    leakage.assert_no_leaks(rows(ROWS, [(1, "p", "c", "t")]), "id")


def test_audit_without_optional_columns(rows):
    leakage.assert_no_leaks(rows("id bigint, prompt string", [(1, "p")]), "id")


def test_cross_against_brute_force(rows):
    rng = random.Random(11)
    words = ["a", "b", "c", " a ", "", "end"]
    text = lambda n: "\n".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 12))) for i in range(120)]
    items = [(i, text(rng.randint(0, 4))) for i in range(40)]
    lines = lambda t: [x.strip() for x in t.splitlines() if x.strip()]

    def inside(item, doc):
        a, b = lines(item), lines(doc)
        return bool(a) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))

    want = {}
    for item_id, item in items:
        hits = [doc_id for doc_id, doc in docs if inside(item, doc)]
        if hits:
            want[item_id] = (len(hits), hits[:10])
    documents, passages = rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items)
    got = {r["item_id"]: (r["n_docs"], r["first_docs"]) for r in leakage.leak_cross(documents, passages).collect()}
    assert got == want
    per_doc = {r["doc_id"]: r["n_blocks"] for r in leakage.leak_cross_documents(documents, passages).collect()}
    distinct = {tuple(lines(t)) for _, t in items if lines(t)}
    assert per_doc == {
        d: n for d, t in docs if (n := sum(inside("\n".join(block), t) for block in distinct))
    }


@pytest.mark.parametrize("sizes", [(1 << 18, 1 << 19), (300, 20_000)])
def test_boilerplate_only_passages(rows, monkeypatch, sizes):
    """Documents and passages that consist of the same three lines, also over many parts and groups."""
    monkeypatch.setattr(leakage, "PART_LINES", sizes[0])
    monkeypatch.setattr(leakage, "GROUP_LINES", sizes[1])
    rng = random.Random(2)
    lines = lambda n: "\n".join(rng.choices("abc", k=n))
    docs = [(i if i % 9 else None, lines(rng.randrange(1, 400))) for i in range(60)] + [(5, lines(3)), (70, None)]
    items = [(i, lines(rng.randrange(1, 14))) for i in range(80)] + [(90, lines(300))]
    hits = {(d, t) for d, doc in docs for _, t in items if doc and f"\n{t}\n" in f"\n{doc}\n"}
    documents, passages = rows("doc_id bigint, text string", docs), rows("item_id bigint, text string", items)
    got = {r["doc_id"]: r["n_blocks"] for r in leakage.leak_cross_documents(documents, passages).collect()}
    assert got == {d: sum(x == d for x, _ in hits) for d, _ in hits}
    report = {r["item_id"]: r["n_docs"] for r in leakage.leak_cross(documents, passages).collect()}
    assert report == {i: n for i, t in items if (n := sum(x == t for _, x in hits))}


def test_work_on_boilerplate_grows_with_the_lines():
    """Four times the lines take far less than sixteen times as long."""

    def seconds(n):
        lines = pa.table({"_row": np.zeros(n, np.int64), "doc_id": np.zeros(n, np.int64), "_pos": np.arange(n, dtype=np.int32), "line_a": np.arange(n) % 2, "line_b": np.zeros(n, np.int32)})
        size = 12
        members = pa.table({
            "block_a": np.repeat(np.arange(200), size), "block_b": np.zeros(200 * size, np.int32), "_off": np.tile(np.arange(size, dtype=np.int32), 200),
            "line_a": (np.arange(200 * size) * 7 // 5) % 2, "line_b": np.zeros(200 * size, np.int32),
        })
        start = time.perf_counter()
        leakage._hits("doc_id")(None, lines, members)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 10 * max(seconds(100_000), 0.01)


def test_evaluate_audits_first(rows):
    from tuneframe import evaluate

    table = rows(
        "example_id bigint, prompt string, completion string, eval_label string, eval_task string",
        [(1, "q", "Final Label: True", "True", "wsc"), (2, "q", "Final Label: False", "False", "wsc")],
    )
    predictions = rows("example_id bigint, run_id string, prediction string", [(1, "r", "Final Label: true"), (2, "r", "?")])
    got = {r["task"]: r["eval_init_small_data_accuracy"] for r in evaluate(table, predictions, ["run_id"], "eval_init").collect()}
    assert got == {"wsc": 0.5, "all": 0.5}
    leaky = table.withColumn("prompt", table["completion"])
    with pytest.raises(ValueError, match="leakage"):
        evaluate(leaky, predictions, ["run_id"])
    with pytest.raises(ValueError, match="needs eval_label"):
        evaluate(table.drop("eval_task"), predictions)
