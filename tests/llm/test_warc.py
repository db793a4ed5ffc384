import hashlib
import random

from pyspark.sql import functions as F

from knockon.llm import warc
from tests.llm.helpers import CLASHING

RECORDS = "record string, file string, offset long, length long, data binary"


def replica(spark, files):
    """files: name -> list of record bytes."""
    rows = []
    for name, records in files.items():
        at = 0
        for i, data in enumerate(records):
            rows.append((f"{name}/{i}", name, at, len(data or b""), data))
            at += len(data or b"x")
    return spark.createDataFrame(rows, RECORDS).withColumns({c: F.lit(1) for c in CLASHING + ("node", "n", "up")})


def files():
    draw = random.Random(1)
    return {f"f{k}": [draw.randbytes(draw.choice([10, 300, 5000])) for _ in range(n)]
            for k, n in enumerate([1, 5, 200, 700])}


def found(a, b, **sizes):
    return sorted((r.file, r.offset, r.status) for r in warc.audit(a, b, **sizes).collect())


def test_damage_is_located_exactly(spark):
    good, bad = files(), files()
    places = {name: [sum(map(len, records[:i])) for i in range(len(records))] for name, records in good.items()}
    first = replica(spark, good)
    want, lost = [], []
    for name, i in (("f0", 0), ("f2", 17), ("f2", 18), ("f3", 699), ("f3", 0)):
        data = bytearray(bad[name][i])
        data[len(data) // 2] ^= 1
        bad[name][i] = bytes(data)
        want.append((name, places[name][i], "changed"))
    second = replica(spark, bad)
    for name, i in (("f1", 2), ("f3", 400)):
        second = second.where((F.col("file") != name) | (F.col("offset") != places[name][i]))
        lost.append((name, places[name][i], "missing"))
    for sizes in ({}, {"range_bytes": 1000, "fan_out": 2}):
        assert found(first, second, **sizes) == sorted(want + lost)
        assert found(second, first, **sizes) == sorted(want + [(n, o, "extra") for n, o, _ in lost])
        assert found(first, first, **sizes) == []


def test_whole_files_nulls_repeats_and_empty_replicas(spark):
    good = files()
    first = replica(spark, good)
    some = first.where("file <> 'f1'")
    assert found(first, some) == sorted((r.file, r.offset, "missing") for r in first.where("file = 'f1'").collect())
    assert len(found(first, first.where("file = 'none'"))) == first.count()
    assert found(first.limit(0), first.limit(0)) == []
    twice = first.unionByName(first.where("file = 'f0'"))
    assert found(first, twice) == [("f0", 0, "changed")] and found(twice, twice) == []
    nothing = replica(spark, {"a": [None, b""]})
    assert found(nothing, nothing) == []


def pages(spark, n=60):
    draw = random.Random(2)
    rows = [(i, f"http://h{i}.org/é", "<p>" + "ab\r\n\r\nWARC/1.0 é" * draw.randint(0, 9)) for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, None), (3, "http://again", "")], "page_id long, url string, html string")


def test_files_round_trip(spark, tmp_path):
    table = pages(spark)
    warc.write_files(table, str(tmp_path / "one"), per_file=7)
    read = warc.read_files(spark, str(tmp_path / "one" / "*.txt"))
    rows = read.collect()
    assert len(rows) == table.count()
    bodies = sorted(bytes(r.data).split(b"\r\n\r\n", 1)[1][:-4].decode() for r in rows)
    assert bodies == sorted(r.html or "" for r in table.collect())
    ends = {}
    for r in sorted(rows, key=lambda r: (r.file, r.offset)):
        assert r.offset == ends.get(r.file, 0) and r.length == len(r.data)
        ends[r.file] = r.offset + r.length
    assert warc.audit(read, read).count() == 0
    cut = list(warc.split_records(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nnot a record"))
    assert [(at, data) for _, at, data in cut][1] == (38, b"not a record")


def test_packed_pages_have_running_offsets(spark):
    rows = warc.pack(pages(spark), per_file=5).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.file, r.offset)):
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.length
    assert len(rows) == 62 and warc.pack(pages(spark).limit(0)).count() == 0
    lost = warc.pack(pages(spark), per_file=5, stored=lambda i, d: F.when(i != 9, d))
    out = warc.audit(warc.pack(pages(spark), per_file=5), lost).collect()
    assert sorted((r.record, r.status) for r in out) == [("", "missing"), ("9", "missing")]


def test_digest_is_of_the_record_bytes(spark):
    one = pages(spark).where("page_id = 4")
    page = one.first()
    body = page.html.encode()
    want = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:4>\r\nWARC-Target-URI: {page.url}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    assert warc.pack(one).first().digest == hashlib.sha256(want).hexdigest()
