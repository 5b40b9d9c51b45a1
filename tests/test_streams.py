import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tuneframe.session import run_folder
from tuneframe.streaming import growing, jobs


def local(folder):
    return folder.removeprefix("file://")


def put(path, data, mode="ab"):
    with open(path, mode) as out:
        out.write(data)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def folder(spark, tmp_path):
    return str(tmp_path)


def part_of(path, first, start, end, last):
    return growing.Part(path, first, start, end, last)


def lines(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += list(zip(*(c.to_pylist() for c in batch.columns)))
    return out


@pytest.mark.parametrize("part_bytes", [1, 3, 10, 10**6])
def test_offsets_give_every_complete_line_once(folder, part_bytes):
    rng = random.Random(part_bytes)
    reader = growing.GrowingReader({"path": folder, "suffix": ".log", "partBytes": str(part_bytes)})
    text = [("x" * rng.randrange(0, 9) + rng.choice(["", "é", "\\", "\r"])).encode() + rng.choice([b"\n", b"\r\n"]) for _ in range(120)]
    data, sent, got, at = b"".join(text), 0, [], reader.initialOffset()
    put(f"{folder}/other.txt", b"not read\n")
    while sent < len(data):
        more = min(len(data), sent + rng.randrange(1, 40))
        put(f"{folder}/a.log", data[sent:more])
        sent = more
        if rng.random() < 0.3:  # a restart: nothing but the offset is kept
            reader = growing.GrowingReader({"path": folder, "suffix": ".log", "partBytes": str(part_bytes)})
        end = reader.latestOffset()
        whole = data[:sent].rfind(b"\n") + 1
        assert json.loads(end["files"]) == ({f"{folder}/a.log": whole} if whole else {})
        new = lines(reader, at, end)
        assert new == lines(reader, at, end)  # a replay reads the same
        got += new
        at = end
    assert [v for _, _, v in got] == [t.decode().removesuffix("\n").removesuffix("\r") for t in text]
    assert [s for _, s, _ in got] == [sum(map(len, text[:i])) for i in range(len(text))]


def test_long_lines_new_files_and_files_written_anew(folder):
    reader = growing.GrowingReader({"path": folder})
    put(f"{folder}/a", b"y" * 200_000)
    assert reader.latestOffset() == {"files": "{}"}  # no line end yet
    put(f"{folder}/a", b"\nrest")
    first = reader.latestOffset()
    assert [len(v) for _, _, v in lines(reader, reader.initialOffset(), first)] == [200_000]
    put(f"{folder}/a", b"short\n", "wb")
    put(f"{folder}/b", b"one\ntwo\n")
    second = reader.latestOffset()
    assert [v for _, _, v in lines(reader, first, second)] == ["short", "one", "two"]
    assert lines(reader, second, second) == []
    assert growing.GrowingReader({"path": f"{folder}/none"}).latestOffset() == {"files": "{}"}
    single = growing.GrowingReader({"path": f"file://{folder}/b"})
    assert [v for _, _, v in lines(single, single.initialOffset(), single.latestOffset())] == ["one", "two"]


def test_metrics_of_runs_that_still_write(spark, folder):
    sink, state = (run_folder(spark, f"test-{x}") for x in ("sink", "state"))

    def run():
        jobs.stream_run_log(spark, folder, sink, state, growing=True).awaitTermination()
        return sorted(map(tuple, spark.read.schema("run_name string, name string, value double, batch int").parquet(sink).select("run_name", "name", "value").collect()))

    put(f"{folder}/r1_20240101_000000.log", b'[eval_5] {"m": 1.0}\nnoise\n[eval_6] {"m": 2.0, "k"')
    assert run() == [("r1", "m", 1.0)]
    put(f"{folder}/r1_20240101_000000.log", b': 3}\n[eval_7] {"m":')
    put(f"{folder}/r2.log", b'[eval_1] {"m": 9}\n')
    assert run() == [("r1", "k", 3.0), ("r1", "m", 1.0), ("r1", "m", 2.0), ("r2", "m", 9.0)]
    assert len(run()) == 4  # nothing new
    put(f"{folder}/r1_20240101_000000.log", b" 4.0}\n")
    assert run()[-2:] == [("r1", "m", 4.0), ("r2", "m", 9.0)]
    latest = {(r["run_name"], r["name"]): r["value"] for r in jobs.latest_from_sink(spark, sink).collect()}
    assert latest == {("r1", "m"): 4.0, ("r1", "k"): 3.0, ("r2", "m"): 9.0}


SCHEMA = "ts timestamp, run_id string, example_id long, step long, prediction string"


def at(minute):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute) if minute is not None else None


def test_on_time_repeated_and_late_rows_are_all_kept(spark, rows, folder):
    """Three batches with a restart before each."""
    source, sink, state = (run_folder(spark, f"test-{x}") for x in ("source", "sink", "state"))
    references = rows("example_id long, task string, reference string", [(i, "wsc", "True") for i in range(50)])
    answer = "Final Label: True"
    batches = [
        [(at(0), "r", 1, 1, answer), (at(1), "r", 2, 1, "?"), (at(1), "r", 2, 1, "?"), (at(200), "r", 3, 1, answer)],
        # The watermark is at 140 minutes now.
        [(at(10), "r", 4, 1, answer), (at(139), "r", 5, 1, answer), (at(141), "r", 6, 1, answer), (at(205), "r", 3, 1, answer), (at(20), "r", 1, 1, answer), (None, "r", 7, 1, answer)],
        [(at(150), "r", 6, 1, answer), (at(210), "r", 99, 1, answer), (at(90), "q", 6, 1, answer), (at(90), "q", 6, 1, answer)],
    ]
    for batch in batches:
        rows(SCHEMA, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        jobs.stream_arrivals(jobs.scored_arrivals(jobs.arrivals(stream, delay="1 hour"), references), sink, state).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.count() == sum(map(len, batches))
    by = {}
    for r in got.collect():
        by.setdefault(r["arrival"], []).append((r["run_id"], r["example_id"], r["accuracy"], r["status"]))
    assert sorted(by["late"]) == sorted([("r", 4, 1.0, "ok"), ("r", 5, 1.0, "ok"), ("r", 1, 1.0, "ok"), ("r", 7, 1.0, "ok"), ("q", 6, 1.0, "ok"), ("q", 6, 1.0, "ok")])
    assert sorted(by["repeated"]) == [("r", 2, 0.0, "ok"), ("r", 3, 1.0, "ok"), ("r", 6, 1.0, "ok")]
    assert sorted(by["on_time"], key=str) == sorted([("r", 1, 1.0, "ok"), ("r", 2, 0.0, "ok"), ("r", 3, 1.0, "ok"), ("r", 6, 1.0, "ok"), ("r", 99, None, "missing_reference")], key=str)


def test_a_key_is_forgotten_when_its_timer_runs_out(spark, rows):
    source, sink, state = (run_folder(spark, f"test-{x}") for x in ("source", "sink", "state"))
    references = rows("example_id long, task string, reference string", [])
    for batch in ([(at(0), "r", 1, 1, "")], [(at(300), "r", 2, 1, "")], [(at(301), "r", 2, 1, "")], [(at(250), "r", 1, 1, "")]):
        rows(SCHEMA, batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        jobs.stream_arrivals(jobs.scored_arrivals(jobs.arrivals(stream), references), sink, state).awaitTermination()
    got = sorted((r["example_id"], r["arrival"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "on_time"), (1, "on_time"), (2, "on_time"), (2, "repeated")]


def test_the_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with jobs.rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


class _Handle:
    """State of one bucket without a stream."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)


class _Time:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_keys_of_a_bucket_share_one_call_and_one_state():
    handle, minute = _Handle(), 60_000
    arrivals = jobs._Arrivals(["n"], 60 * minute * 1000)
    arrivals.init(handle)

    def call(watermark, *given):
        rows = [(i, None, 0, bytes([key]) * 16, m * minute * 1000) for i, (key, m) in enumerate(given)]
        parts = [pd.DataFrame(rows[i : i + 2]) for i in range(0, len(rows), 2)]
        out = pd.concat(list(arrivals.handleInputRows((0,), iter(parts), _Time(watermark * minute))))
        assert out["n"].tolist() == list(range(len(given)))
        return out["arrival"].tolist()

    # The earliest row of a key is the first one, wherever it stands; a key may be all zero bytes.
    assert call(100, (0, 110), (1, 105), (0, 101), (2, 99), (1, 105)) == ["repeated", "on_time", "on_time", "late", "repeated"]
    assert handle.timers == [161 * minute]
    list(arrivals.handleExpiredTimer((0,), _Time(162 * minute), _Time(161 * minute)))
    assert handle.timers == [161 * minute, 165 * minute]
    assert call(162, (0, 163), (1, 164), (3, 170)) == ["on_time", "repeated", "on_time"]
    list(arrivals.handleExpiredTimer((0,), _Time(500 * minute), _Time(165 * minute)))
    assert handle.value is None
