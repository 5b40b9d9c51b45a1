import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tuneframe import schemas, sources
from tuneframe.session import run_folder
from tuneframe.sources import json_rows as J

SCHEMA = "a string, b array<struct<c:string,d:string>>, n bigint"
NASTY = ["}", "{", "]", "[", ",", '"', "\\", '\\"', "\\\\", '"},{"', "],[", "é", "\n", "\t", "", "a}{b", "\\\\\\\"}", " ", "}" * 20]


def values(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choices(NASTY, k=rng.randrange(0, 5)))
    return [{"a": text(), "b": [{"c": text(), "d": text()} for _ in range(rng.randrange(3))], "n": rng.choice([i, None])} for i in range(n)]


def ranges_of(rows, files):
    """Ranges cut at the given places of each file's bytes."""
    out = []
    for name, data, cuts in files:
        bounds = sorted({0, len(data), *cuts})
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            exits, deltas = J.summary(np.frombuffer(data[a:b], np.uint8))
            start = data[a:b].lstrip()[:1]
            out.append((name, i // 3, i % 3, bytearray(data[a:b]), exits, deltas, start[0] if start else None))
    return rows(J.RANGES, out)


def elements(frame):
    found = {}
    for r in frame.orderBy("file", "block", "seq", "at").collect():
        found.setdefault(r["file"], []).append(json.loads(r["text"]))
    return found


def test_border_at_every_byte(rows):
    """Braces, quotes and escapes right before and right behind every border."""
    documents = [json.dumps(values(6, 1)), json.dumps(values(5, 2), indent=2, ensure_ascii=False), "\n".join(json.dumps(v) for v in values(4, 3)), "[]", " [ [1, [2]], 3 , \"x,]\" ]\n"]
    want, files = {}, []
    for i, text in enumerate(documents):
        data = text.encode()
        for step in (1, 2, 3, 7, 10**6):
            name = f"{i}-{step}"
            files.append((name, data, range(0, len(data), step)))
            want[name] = json.loads(text) if text.strip()[:1] == "[" else [json.loads(line) for line in text.split("\n")]
    got = elements(J._elements(ranges_of(rows, files)))
    assert got == {k: v for k, v in want.items() if v}


def test_lexer_functions_compose():
    """From any place, in the state that the document has there, parts come to the same as the whole."""
    data = json.dumps(values(40, 5), ensure_ascii=False).encode()
    rng = random.Random(2)
    seen = set()
    for _ in range(300):
        start = rng.randrange(1, len(data) - 20)
        entry = J.lex(np.frombuffer(data[:start], np.uint8), J.OUTSIDE)[1]
        seen.add(entry)
        exits, deltas = J.summary(np.frombuffer(data[start:], np.uint8))
        bounds = [start, *sorted(rng.sample(range(start + 1, len(data)), 12)), len(data)]
        state, depth = entry, 0
        for a, b in zip(bounds, bounds[1:]):
            own_exits, own_deltas = J.summary(np.frombuffer(data[a:b], np.uint8))
            state, depth = own_exits[state], depth + own_deltas[state]
        assert (state, depth) == (exits[entry], deltas[entry]) == (J.OUTSIDE, depth)
    assert seen == {J.OUTSIDE, J.STRING, J.ESCAPED}


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write_file(spark, text, name="data.json"):
    folder = run_folder(spark, "json-test")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(text.encode()))
    stream.close()
    return folder


@pytest.mark.parametrize("form", ["array", "pretty", "brackets only", "objects", "ends in brace", "crlf"])
def test_same_rows_as_multi_line_read_over_several_tasks(spark, small_splits, form):
    data = values(300, 7)
    text = {
        "array": lambda: json.dumps(data),
        "pretty": lambda: json.dumps(data, indent=3, ensure_ascii=False) + "\n\n",
        "brackets only": lambda: "[" + ",\n".join(json.dumps(v) for v in data) + "]",
        "objects": lambda: "\n".join(json.dumps(v) for v in data) + "\n",
        "ends in brace": lambda: " ".join(json.dumps(v, indent=1) for v in data),
        "crlf": lambda: json.dumps(data, indent=1).replace("\n", "\r\n"),
    }[form]()
    path = write_file(spark, text)
    key = lambda r: json.dumps(r.asDict(True), sort_keys=True)
    got = J.read_json_rows(spark, path, SCHEMA, row_idx="row_idx", range_bytes=500)
    blocks = J._ranges(spark, path, 500).select("file", "block").distinct()
    assert blocks.count() > 20  # a file, many tasks
    ordered = got.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in ordered] == list(range(300)) and [r.asDict(True) | {"row_idx": 0} for r in ordered] == [v | {"row_idx": 0} for v in data]
    if "objects" not in form and form != "ends in brace":
        multi = spark.read.schema(SCHEMA).json(path, multiLine=True)
        assert sorted(map(key, got.drop("row_idx").collect())) == sorted(map(key, multi.collect()))


def test_several_files_and_odd_elements(spark):
    folder = write_file(spark, '[{"a":"x"}, 5, null, [1], {"n": "no number"}, {"a": "y"},]', "1.json")
    for name, text in (("2.json", ""), ("3.json", "  \n"), ("4.json", "[ ]"), ("5.json", '[{"a":"cut off'), ("6.json", '{"a":"z"}')):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        stream.write(bytearray(text.encode()))
        stream.close()
    got = J.read_json_rows(spark, folder, SCHEMA, row_idx="at").orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(8)) and [r["a"] for r in got if r["a"]] == ["x", "y", "z"]
    assert J.json_elements(spark, folder).where(F.col("text").contains("cut off")).count() == 1


def test_arrays_are_written_and_read_back(spark, rows):
    data = values(50, 9)
    frame = spark.createDataFrame([(v["a"], [(x["c"], x["d"]) for x in v["b"]], v["n"]) for v in data], SCHEMA)
    path = run_folder(spark, "arrays")
    sources.write_json_arrays(frame.repartition(3), path)
    key = str
    assert sorted(map(key, sources.read_json_rows(spark, path, frame.schema).collect())) == sorted(map(key, frame.collect()))
    assert sorted(map(key, spark.read.schema(frame.schema).json(path, multiLine=True).collect())) == sorted(map(key, frame.collect()))
    sources.write_json_arrays(frame.limit(0), run_folder(spark, "arrays"))


def test_readers(spark):
    rows = [{"prompt": 'p "{[', "name": f"n{i}", "golden_answer": [{"Action": "a", "Action_Input": "{\"k\": [1]}"}], "golden_response": None} for i in range(9)]
    path = write_file(spark, json.dumps(rows, indent=2))
    got = sources.read_tooluse(spark, path, multi_line=True, row_idx="row_idx")
    assert [r["name"] for r in got.orderBy("row_idx").collect()] == [f"n{i}" for i in range(9)]
    assert got.drop("row_idx").schema == schemas.TOOLUSE_RAW
    with pytest.raises(ValueError):
        sources.read_tooluse(spark, path, row_idx="row_idx")
    manifests = [{"version": 1, "description": "}", "tasks": {f"t{i}": {"train_indices": [3, 1.0, "1", True, 4], "rationale": "[]"}}} for i in range(3)]
    path = write_file(spark, json.dumps(manifests))
    large = sources.read_fewshot_manifest(spark, path, large=True)
    assert sorted(map(tuple, large.collect()), key=str) == sorted(map(tuple, sources.read_fewshot_manifest(spark, path).collect()), key=str)
    assert large.where("row_idx is null").count() == 9 and sources.read_fewshot_manifest(spark, path, "t1", large=True).count() == 5
