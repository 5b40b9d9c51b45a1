import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import plan_of
from tuneframe.constants import TASK_LABELS
from tuneframe.functions import labels as L
from tuneframe.operators import scoring

VECTORS = [
    ("copa", "Final Label: choice1 OR Final Label: choice2", "choice1"),
    ("cb", "Final Label: entailment OR contradiction OR neutral", "entailment"),
    ("wsc", "Final Label:\nTrue", "True"),
    ("wsc", "FINALLABEL:**True**.", "True"),
    ("wsc", "Final Label: True\nFinal Label: unsure", "True"),
    ("wsc", "Final Label: falsehood", None),
    ("wsc", "Final Label: not true", None),
    ("copa", "Final Label: choice_1", None),
    ("copa", "Final Label: choice1.", "choice1"),
    ("copa", "Final Label:", None),
    ("wsc", "Final Label: False\nFinal Label: True!", "True"),
    ("cb", "The relation is entailment based on the premise.", None),
    ("copa", "I cannot decide.", None),
    ("wsc", "final label :\x1ctrue", "True"),
    ("copa", "FİNAL LABEL: choice2", "choice2"),
]


def test_final_label_vectors(rows):
    df = rows("id int, task string, prediction string", [(i, t, p) for i, (t, p, _) in enumerate(VECTORS)])
    parsed = df.select("id", L.parse_final_label(F.col("prediction"), F.col("task")).alias("label"))
    got = {r["id"]: r["label"] for r in parsed.collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(VECTORS)}


def expected_label(prediction, task):
    """The rule in words: last marker whose first words, punctuation aside, are a label."""
    best = None
    for found in re.finditer(r"final\s*label\s*:\s*([^\n\r]+)", prediction, re.IGNORECASE):
        words = " ".join(re.sub(r"[^a-z0-9_ ]+", " ", found.group(1).lower()).split())
        for label in TASK_LABELS[task]:
            if (words + " ").startswith(label.lower() + " "):
                best = label
    return best


def test_final_label_fuzz(rows):
    rng = random.Random(7)
    pieces = ["Final Label:", "final  label :", "FINAL\tLABEL:", "True", "false", "choice1", "choice2.", "neutral", "**", " ",
              "\n", "\r\n", "entailment", "_", "-", "x", " ", "ß", "contradiction", "İ", "ſ", "\x0b", "label:", "0"]
    data = []
    for i in range(3000):
        task = rng.choice(list(TASK_LABELS))
        data.append((i, task, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))))
    df = rows("id int, task string, prediction string", data)
    parsed = df.select("id", L.parse_final_label(F.col("prediction"), F.col("task")).alias("label"))
    got = {r["id"]: r["label"] for r in parsed.collect()}
    wrong = [(p, got[i], expected_label(p, t)) for i, t, p in data if got[i] != expected_label(p, t)]
    assert not wrong, wrong[:5]


def test_scores(rows):
    df = rows(
        "example_id int, task string, prediction string, reference string",
        [
            (1, " COPA ", "Final Label: choice1", "choice1"),
            (2, "cb", "Final Label: neutral", "Neutral."),
            (3, "wsc", "Final Label: False", "False"),
            (4, "wsc", "no marker True", "True"),
            (5, "wsc", "Final Label: True", "False"),
        ],
    )
    got = {r["example_id"]: (r["accuracy"], r["parse_success"]) for r in scoring.score_cls(df).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, 1.0), 3: (1.0, 1.0), 4: (0.0, 0.0), 5: (0.0, 1.0)}


@pytest.mark.parametrize("task, reference", [("rte", "True"), ("wsc", "maybe"), ("wsc", None)])
def test_bad_task_or_reference_is_an_error(rows, task, reference):
    df = rows("task string, prediction string, reference string", [(task, "Final Label: True", reference)])
    with pytest.raises(PySparkException):
        scoring.score_cls(df).collect()
    row = scoring.score_cls(df, strict=False).first()
    assert row["accuracy"] is None and row["parse_success"] is None


def test_alignment(rows):
    predictions = rows("example_id int, prediction string", [(1, "a"), (1, "b"), (2, "c")])
    references = rows("example_id int, reference string", [(1, "x"), (3, "y")])
    aligned = scoring.align_predictions(predictions, references)
    got = sorted((r["example_id"], r["prediction"] or "", r["status"]) for r in aligned.collect())
    assert got == [(1, "a", "ok"), (1, "b", "ok"), (2, "c", "missing_reference"), (3, "", "missing_prediction")]
    with pytest.raises(ValueError, match="same length"):
        scoring.require_aligned(aligned)
    scoring.require_aligned(aligned.where(F.col("status") == "ok"))


def test_means_per_task_and_overall(rows):
    df = rows(
        "run_id string, task string, accuracy double, parse_success double",
        [("r", "copa", 1.0, 1.0), ("r", "copa", 0.0, 1.0), ("r", "wsc", 1.0, 0.0)],
    )
    got = {r["task"]: (r["eval_small_data_accuracy"], r["n"]) for r in scoring.eval_cls(df, ["run_id"]).collect()}
    assert got == {"copa": (0.5, 2), "wsc": (1.0, 1), "all": (pytest.approx(2 / 3), 3)}


def test_label_ids(rows):
    df = rows("task string, label int", [("wsc", 0), ("wsc", 1), ("cb", 2)])
    assert [r[0] for r in df.select(L.label_name(F.col("task"), F.col("label"))).collect()] == ["False", "True", "neutral"]
    for bad in (-1, 2):
        with pytest.raises(PySparkException, match="invalid label id"):
            rows("label int", [(bad,)]).select(L.label_name(F.lit("wsc"), F.col("label"))).collect()


def test_hot_example_is_split(spark, tmp_path):
    """A third of all predictions belong to one example: AQE splits it in the pairing join."""
    path = str(tmp_path / "predictions")
    spark.range(300000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("example_id"),
        F.concat(F.lit("Final Label: "), F.when(F.col("id") % 2 == 0, "True").otherwise("False")).alias("prediction"),
        F.md5(F.col("id").cast("string")).alias("run_id"),
    ).write.parquet(path)
    references = spark.range(300000).select(
        F.col("id").alias("example_id"), F.lit("wsc").alias("task"), F.lit("True").alias("reference")
    )
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "300kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {key: spark.conf.get(key, None) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        predictions = scoring.with_answers(spark.read.parquet(path))
        scored = scoring.score_cls(scoring.pair_predictions(predictions, references))
        total = scored.groupBy("run_id").agg(F.sum("accuracy").alias("hits")).agg(F.sum("hits"))
        assert total.collect()[0][0] == 150000.0
        assert "skew=true" in plan_of(total)
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
