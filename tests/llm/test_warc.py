"""WARC: exact round trip, revisits, and faults that the reader must refuse."""

import struct

import pytest
from pyspark.sql import functions as F

from arcweft.llm import warc
from arcweft.shared import fresh_path


def test_round_trip(spark):
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://b\r\nc", None), (4, "u", ""), (5, "u", "é" * 100_000), (5, "u", "é" * 100_000), (6, "u", "P*M\x18\0\0\0\0" * 50), (None, "n", "x"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]
    rows += [(100 + i, f"http://s/{i}", f"<html>{i % 7} common words and more common words</html>") for i in range(60)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int").repartition(3)
    path = fresh_path(spark, "test")
    warc.write(warc.with_revisits(pages.drop("refers_to")), path)
    got = warc.read(spark, path).collect()
    html = {r[0]: r[2] or "" for r in rows}
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in rows)
    for r in got:
        text = html[r.page_id].encode()
        same = [i for i, h in html.items() if i is not None and h.encode() == text]
        leader = max(same, default=None)
        assert r.payload_bytes == len(text)
        if r.page_id is None or r.page_id == leader:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, text)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", leader, None)


def test_any_bytes_and_many_archives():
    """The line mark may stand in a payload, even where compression repeats it; archives end at their size."""
    import random

    rng = random.Random(4)
    for n in (100, 20_000, 150_000):
        noise = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        mark = b"P*M\x18\0\0\0\0"
        records = [warc.record(i, "http://h", noise + mark + noise[: n // 2] + mark, None) for i in range(12)]
        files = list(warc.archives(iter(records), 200_000))
        assert len(files) > (1 if n > 100_000 else 0)
        got = [(f, b) for x in files for f, b in warc.read_file(x)]
        assert [warc.page_of(f["warc-record-id"]) for f, _ in got] == list(range(12))
        assert all(b.endswith(noise[: n // 2] + mark) for _, b in got)


def test_half_of_all_pages_are_copies(spark):
    """Payloads of copies are not shuffled: what a revisit needs are ids and digests."""
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("copy"), F.repeat(F.lit("z"), 50))).otherwise(F.concat(F.lit("own"), F.col("id"))).alias("html"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op4_warc(pages).collect()}
    assert got == {i: ("revisit", 3998) if i % 2 == 0 and i < 3998 else ("response", None) for i in range(4000)}
    plan = warc.with_revisits(pages).where("refers_to is not null")
    assert plan.select(F.max("html")).first()[0] is None


def test_empty_and_no_revisits_under_a_size(spark):
    assert warc.op4_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert [tuple(r) for r in warc.with_revisits(pages, 3).where(F.col("refers_to").isNotNull()).select("page_id", "refers_to").collect()] == [(3, 4)]


def test_faults_are_refused():
    records = [warc.record(i, f"http://h/{i}", b"some text that repeats " * i, None) for i in range(30)]
    (good,) = warc.archives(iter(records))
    lead = 8 + struct.unpack("<I", good[4:8])[0]
    assert len(list(warc.read_file(good))) == 30
    assert lead > 8  # a dictionary was trained
    for bad in (good[8:], good[:-3], good[: lead + 8] + b"junk", struct.pack("<II", 0x184D2A5D, 10**6)):
        with pytest.raises(warc.WarcError):
            list(warc.read_file(bad))
    for raw in (b"WARC/0.9\r\n\r\n", records[3].replace(b"Content-Length: 1", b"Content-Length: 2", 1), records[3].replace(b"text", b"TEXT", 1), records[3].replace(b"WARC-Type", b"X-Type")):
        lead = warc.dictionary_frame([])[0]
        import zstandard

        with pytest.raises(warc.WarcError):
            list(warc.read_file(lead + zstandard.ZstdCompressor().compress(raw)))
