"""WARC round trip and salvage of damaged archives."""

from __future__ import annotations

import hashlib
import io
import random
from collections import Counter

import duckdb
import pytest

from reelweave.llm import queries, warc

DATE = "2024-01-01T00:00:00Z"


def archive(n, packed=True):
    rng = random.Random(1)
    parts = []
    for i in range(n):
        body = bytes(rng.randrange(32, 127) for _ in range(rng.randrange(0, 4000)))
        data = warc.record(i, f"http://x/{i}", body, None if i % 5 else 0 if i else None, DATE)
        parts.append(warc.member(data) if packed else data)
    return parts


@pytest.mark.parametrize("packed", [True, False])
def test_clean_archive(packed):
    parts = archive(40, packed)
    rows = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [warc.page_of(r["record_id"]) for r in rows] == list(range(40))
    assert all(r["kind"] == "record" for r in rows)


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("how", ["flip", "cut", "junk", "tail"])
def test_salvage(packed, how):
    parts = archive(30, packed)
    hurt = {3, 4, 17}
    for i in hurt:
        p = parts[i]
        if how == "flip":
            at = len(p) - 40 if len(p) > 300 else len(p) // 2
            parts[i] = p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :]
        elif how == "cut":
            parts[i] = p[: len(p) - 30]
        elif how == "junk":
            parts[i] = b"\x1f\x8b\x08 WARC/1.0 nothing" * 3 + p
    data = b"".join(parts)
    if how == "tail":
        data, hurt = data[:-25], {29}
    rows = list(warc.salvage(io.BytesIO(data)))
    found = [warc.page_of(r["record_id"]) for r in rows if r["kind"] == "record"]
    want = [i for i in range(30) if how == "junk" or i not in hurt]
    assert found == want
    gaps = [r for r in rows if r["kind"] == "gap"]
    assert gaps and all(g["reason"] for g in gaps)
    covered = sorted({(r["start"], r["stop"]) for r in rows})
    assert covered[0][0] == 0 and covered[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_long_archives_are_read_in_pieces():
    big = warc.member(warc.record(1, None, random.Random(2).randbytes(3_000_000), None, DATE))
    data = b"x" * 200_000 + big + b"\x00" * 100_000 + big
    rows = list(warc.salvage(io.BytesIO(data)))
    assert [r["kind"] for r in rows] == ["gap", "record", "gap", "record"]
    assert rows[2]["stop"] - rows[2]["start"] == 100_000


def test_round_trip_of_odd_pages(spark):
    long = "ä long page " * 50_000
    rows = [(1, "http://a", "x" * 100, 1), (2, None, "x" * 100, 1), (3, "http://a\r\nEvil: 1", "x" * 99, 1), (4, "u", "x" * 99, 1), (5, "u", None, 1), (6, "u", "", 1), (None, "u", "x" * 100, 1)]
    rows += [(7, "u", long, 1), (8, "u", long, 1), (8, "u", long, 1), (-9, "u", "WARC/1.1\r\n\r\n" * 40, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind int")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages).collect())

    def row(p, html, ref=None):
        b = (html or "").encode()
        return (p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref is not None else "response", ref)

    want = Counter([row(p, h, {2: 1, 8: 7}.get(p)) for p, _, h, _ in rows])
    assert got == want
    assert warc.round_trip(spark, pages.where("false")).collect() == []


def test_twin(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = queries.QUERIES["op7_salvage_warc"](spark, sf)
    rows = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.oracle()})").fetchall()
    assert Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == Counter(rows)


def test_payloads_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(20)
    folder = warc.shared_folder(spark) + "/payloads"
    archives = warc.write_warc(warc.with_revisits(pages), folder, archive_bytes=10_000)
    read = warc.read_warc(archives)
    assert read.rdd.getNumPartitions() == min(archives.count(), 2 * spark.sparkContext.defaultParallelism) > 1
    rows = read.collect()
    want = {r["page_id"]: (r["html"], r["url"]) for r in pages.collect()}
    assert {warc.page_of(r["record_id"]): (bytes(r["payload"]).decode(), r["target_uri"]) for r in rows} == want
    assert len({r["archive"] for r in rows}) > 1


@pytest.mark.parametrize("how", ["digest", "cut", "last", "flip"])
def test_records_before_damage_in_a_member(how):
    whole = [warc.record(i, f"http://x/{i}", random.Random(i).randbytes(3000), None, DATE) for i in range(4)]
    after = warc.member(warc.record(9, "u", b"after", None, DATE))
    if how == "digest":
        whole[2] = whole[2][:-10] + b"xxxxxx" + whole[2][-4:]
    packed = warc.member(b"".join(whole))
    if how in ("cut", "last"):
        packed = packed[: len(packed) - 5000]
    elif how == "flip":
        packed = packed[:-4000] + bytes([packed[-4000] ^ 0x55]) + packed[-3999:]
    data = packed + (b"" if how == "last" else after)
    rows = list(warc.salvage(io.BytesIO(data)))
    assert [warc.page_of(r["record_id"]) for r in rows if r["kind"] == "record"] == [0, 1] + [9] * (how != "last")
    gap = [r for r in rows if r["kind"] == "gap"]
    assert [(g["start"], g["stop"]) for g in gap] == [(0, len(packed))]


@pytest.mark.parametrize("packed", [True, False])
def test_long_headers(packed):
    data = warc.record(1, "http://x/" + "u" * 1_200_000, b"page", None, DATE)
    rows = list(warc.salvage(io.BytesIO(warc.member(data) if packed else data)))
    assert [(r["kind"], len(r["target_uri"])) for r in rows] == [("record", 1_200_009)]


def test_missing_records_fail_the_read(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u" * 1_200_000, "y" * 200)], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.round_trip(spark, pages).collect()) == [1, 2]
    manifest = warc.write_warc(warc.with_revisits(pages), warc.shared_folder(spark) + "/missing")
    with pytest.raises(Exception, match="records read"):
        warc.read_warc(manifest.selectExpr("archive", "records + 1 AS records"), counted=True).collect()
