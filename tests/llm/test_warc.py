import glob
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tuneframe.llm import warc
from tuneframe.session import run_folder

PAGES = "page_id long, url string, html string"
LONG = "<p>some words that fill a page</p>" * 10


def archived(spark, pages, **options):
    path = run_folder(spark, "test-warc")
    warc.archive_pages(pages, path, **options)
    return path


def files_of(path):
    return sorted(glob.glob(f"{path}/**/part-*", recursive=True))


def stored(n=40, seed=3):
    """Plain bytes of records, their ids and the pieces."""
    rng = random.Random(seed)
    pieces = []
    for i in range(n):
        payload = bytes(rng.choices(b"abc <>/\r\n", k=rng.randrange(0, 400)))
        pieces.append(warc.record_bytes(f"urn:page:{i}", f"http://h/{i} x\r\n", payload, hashlib.sha256(payload).hexdigest(), None))
    return pieces


def ids(found):
    return [int(own["record_id"].removeprefix("urn:page:")) for _, _, own, gap in found if gap is None and own["record_id"].startswith("urn:page:")]


def test_round_trip_of_odd_rows(spark, rows):
    huge = "x" * (17 << 20) + "é"
    data = [
        (1, "http://a/", LONG), (2, "http://b/ c\r\nWARC-Type: x", LONG), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
        (None, "u", LONG), (7, "u", huge), (8, "u", huge), (9, "u", "é" * 60), (9, "u", "é" * 60),
    ]
    pages = rows(PAGES, data)
    for options in ({}, {"compress": False}, {"file_bytes": 1}):
        path = archived(spark, pages, **options)
        got = warc.read_warc(spark, path)
        assert got.filter("gap is not null").count() == 0 and warc.orphans(got).count() == 0
        want = []
        for page_id, _, html in data:
            body = (html or "").encode()
            same = [p for p, _, h in data if (h or "").encode() == body and p is not None]
            again = len(body) >= 100 and page_id != min(same)
            want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
        key = str
        assert sorted(map(tuple, warc.read_pages(got).collect()), key=key) == sorted(want, key=key)
        whole = {r["record_id"]: bytes(r["payload"]) for r in got.filter("type = 'response'").collect()}
        assert whole["urn:page:7"] == huge.encode() and whole["urn:page:3"] == b""
    assert len(files_of(path)) == len(data)  # a file is closed once it holds file_bytes


def test_members_are_plain_gzip(spark, rows):
    path = archived(spark, rows(PAGES, [(i, f"http://a/{i}", LONG + str(i)) for i in range(20)]).coalesce(1))
    text = b"".join(gzip.open(f).read() for f in files_of(path))
    assert text.count(b"WARC/1.1\r\n") == 20 and text.endswith(b"\r\n\r\n")


def test_only_null_ids_and_empty_and_clashing(spark, rows):
    got = warc.read_pages(warc.read_warc(spark, archived(spark, rows(PAGES, [(None, None, LONG), (None, None, LONG)])))).collect()
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [(None, "response", None)] * 2
    assert warc.read_pages(warc.read_warc(spark, archived(spark, rows(PAGES, [])))).count() == 0
    names = "payload payload_bytes payload_digest first_id value file type gap"
    wide = rows(PAGES + "".join(f", {n} string" for n in names.split()), [(i, "u", LONG, *["z"] * 8) for i in (1, 2)])
    assert sorted(map(tuple, warc.read_pages(warc.read_warc(spark, archived(spark, wide))).select("page_id", "refers_to").collect())) == [(1, None), (2, 1)]


@pytest.mark.parametrize("pack", [True, False])
def test_every_record_without_damage_is_recovered(pack):
    pieces = [warc.members(p) if pack else p for p in stored()]
    starts = [sum(map(len, pieces[:i])) for i in range(len(pieces) + 1)]
    rng = random.Random(11)
    for _ in range(120):
        data = bytearray(b"".join(pieces))
        hurt = set()
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(data))
            data[at] ^= 1 << rng.randrange(8)
            hurt |= {i for i in range(len(pieces)) if starts[i] <= at < starts[i + 1]}
        found = list(warc.salvage(bytes(data)))
        got = set(ids(found))
        assert got >= set(range(len(pieces))) - hurt
        # Records and gaps cover the file, in order, without overlap.
        places = list(dict.fromkeys((s, n) for s, n, _, _ in found))
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) == len(data)


def test_bytes_removed_and_put_in():
    pieces = [warc.members(p) if i % 2 else p for i, p in enumerate(stored())]  # members and plain records mixed
    whole = b"".join(pieces)
    assert ids(warc.salvage(whole)) == list(range(40))
    rng = random.Random(5)
    for _ in range(60):
        cut = rng.randrange(len(whole) - 300)
        size = rng.randrange(1, 300)
        at, hurt = 0, set()
        for i, p in enumerate(pieces):
            if at < cut + size and cut < at + len(p):
                hurt.add(i)
            at += len(p)
        assert set(ids(warc.salvage(whole[:cut] + whole[cut + size :]))) >= set(range(40)) - hurt
        inside = {i for i in hurt if sum(map(len, pieces[:i])) < cut}
        junk = b"WARC/1.1\r\nnot a record " + bytes(rng.randrange(256) for _ in range(size)) + b"\x1f\x8b\x08"
        assert set(ids(warc.salvage(whole[:cut] + junk + whole[cut:]))) >= set(range(40)) - inside


def test_false_headers():
    good = warc.record_bytes("urn:page:1", None, b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), None)
    other = warc.record_bytes("urn:page:2", None, b"y", hashlib.sha256(b"y").hexdigest(), None)
    longer = good.replace(b"Content-Length: 1", b"Content-Length: 9", 1) if b"Content-Length: 1" in good else good
    for bad, why in (
        (good.replace(b"x" * 50, b"x" * 49 + b"z"), "block digest differs"),
        (good[:-4] + b"abcd", "block is not closed"),
        (good.replace(b"WARC-Type: response\r\n", b""), "no type or record id"),
        (b"WARC/1.1\r\nwithout colon\r\n\r\n", "header line without a name"),
        (longer[: len(longer) - 30], None),
    ):
        found = list(warc.salvage(bad + other))
        assert ids(found) == [2] and found[0][3] is not None and (why is None or found[0][3] == why)
        assert found[0][:2] == (0, len(bad))
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"junk"))[0][3] == "no member or version line"


def test_one_member_for_all_records():
    pieces = stored(6)
    pieces[2] = pieces[2].replace(b"urn:page:2", b"urn:page:9")[:-3] + b"no!"
    found = list(warc.salvage(warc.members(b"".join(pieces))))
    assert ids(found) == [0, 1, 3, 4, 5] and sum(gap is not None for *_, gap in found) == 1


def test_lost_first_records_leave_orphans(spark, rows):
    path = archived(spark, rows(PAGES, [(1, "u", LONG), (2, "u", LONG), (3, "u", "other")]).coalesce(1))
    gone = warc.read_warc(spark, path).withColumn("gap", F.when(F.col("record_id") == "urn:page:1", "lost").otherwise(F.col("gap")))
    assert [r["record_id"] for r in warc.orphans(gone).collect()] == ["urn:page:2"]
