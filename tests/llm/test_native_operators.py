"""Mixing, fingerprints and sharding against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from reelweave.llm import fingerprints, mixing, queries, sharding
from reelweave.session import Stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key int"
SF = "/root/testdata/sf0.001"


def odd_docs(spark, n=0):
    rows = [
        (1, "a b c. d e f\nsecond line", "en", "s1", 5, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s1", 0, "x", 1),
        (4, "a b c. d e f\nsecond line", "en", "s2", 5, "x", 1),
        (4, "a b c. d e f\nsecond line", "en", "s2", 5, "x", 1),
        (None, "öne wörd 😀😀😀 " * 5, "de", "s2", 5, "x", 1),
        (7, "word " * 30_000, "en", None, 5, "x", 1),
        (8, " \t\n", "en", "", 3, "x", 1),
    ] + [(100 + i, f"line {i % 7}. same words here\nand {i} more", "en", f"s{i % 3}", 9, None, i) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark, 40)
    rows = mixing.mix_table(docs).collect()
    assert len(rows) == docs.count()
    per = defaultdict(list)
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        per[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert sum(v[0]["target"] for v in per.values()) == pytest.approx(total)
    for rs in per.values():
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
        largest = max(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(largest / 2, 1)
    again = mixing.mix_table(docs.repartition(7)).collect()
    assert Counter(again) == Counter(rows)


def test_mixed_repeats_whole_rows(spark):
    docs = odd_docs(spark, 40)
    want = Counter()
    for r in mixing.mix_table(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    assert got == +want and mixing.mixed(docs).columns == docs.columns


def test_mix_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.oracle()})").fetchall())
    got = queries.QUERIES["op1_pareto_mix"](spark, SF).select("doc_id", "size", "source_size", "target", "taken")
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("run", [mixing.mix_table, mixing.mixed, fingerprints.edited, sharding.kd_shards])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], DOCS)).collect() == []


def brute_lanes(text):
    units = [u for u in re.split(r"\n+|(?<=[.!?])[ \t]+", text or "") if u]
    windows = []
    for u in units:
        w = re.split(r"[ \t]+", u)
        windows += [" ".join(w[i : i + 4]) for i in range(len(w) - 3) if all(w[i : i + 4]) and (i == 0 or w[i - 1][-1:] in ("l", "r", "t"))]
    signs = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    signs += [xxhash.xxh64_intdigest(u.encode(), xxhash.xxh64_intdigest(b"window", 42)) for u in windows]
    return [sum(h >> b & 1 for h in signs) % 2**14 for b in range(64)], len(signs)


def unpack(fp):
    packed = [int(fp[16 * i : 16 * i + 16], 16) for i in range(21)]
    return [packed[b % 16] >> 16 * (b // 16) & 0x3FFF for b in range(64)], packed[20]


def test_fingerprints_against_brute_force(spark):
    docs = odd_docs(spark, 40)
    rows = docs.collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
    want = Counter()
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, f = r["text"] or "", nxt["text"] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + f[:half]
        want[(r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), str(brute_lanes(t)), str(brute_lanes(e)))] += 1
    for blocks in (1, 4):
        got = fingerprints.edited(docs, blocks=blocks).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], str(unpack(r["fingerprint"])), str(unpack(r["edited_fingerprint"]))) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_fingerprint_order_insert_delete_likeness(spark):
    a = "\n".join(f"paragraph {i}" for i in range(200))
    b = "\n".join(f"paragraph {i}" for i in reversed(range(200)))
    c = "\n".join(f"paragraph {i}" for i in range(100)) + "\n" + "\n".join(f"other {i}" for i in range(100))
    d = "\n".join(f"strange {i}" for i in range(200))
    e = "\n".join(f"paragraph {i}" for i in range(150))
    rest = "\n".join(f"paragraph {i}" for i in range(150, 200))
    df = spark.createDataFrame([(a, b, c, d, e, rest)], "a string, b string, c string, d string, e string, rest string")
    for x in df.columns:
        df = fingerprints.with_lanes(df, df[x], x)
    r = df.select(
        (df.a == df.b).alias("same"),
        (fingerprints.insert(df.e, df.rest) == df.a).alias("added"),
        (fingerprints.delete(df.a, df.rest) == df.e).alias("taken"),
        fingerprints.likeness(df.a, df.c).alias("half"),
        fingerprints.likeness(df.a, df.d).alias("none"),
    ).head()
    assert r["same"] and r["added"] and r["taken"]
    assert 0.3 < r["half"] < 0.7 and r["none"] < 0.4


def test_likeness_of_one_paragraph(spark):
    """Half of a single paragraph is changed: its windows still tell."""
    words = [f"{'wonderful' if i % 5 else 'river'}{i} {'tall' if i % 3 else 'moon'}" for i in range(80)]
    other = [f"strange{i} {'fur' if i % 4 else 'sea'}" for i in range(80)]
    texts = (" ".join(words), " ".join(words[:40] + other[:40]), " ".join(other))
    df = spark.createDataFrame([texts], "a string, half string, none string")
    for x in df.columns:
        df = fingerprints.with_lanes(df, df[x], x)
    r = df.select(*[fingerprints.likeness(df.a, df[x]).alias(x) for x in ("half", "none")]).head()
    assert 0.3 < r["half"] < 0.7 and r["none"] < 0.3


def test_order_of_many_null_ids(spark):
    """Null ids are cut into ranges too; every row but one sees the row after it."""
    rows = [(None, f"text {i % 150} of nobody") for i in range(300)] + [(i // 2, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for blocks in (1, 7):
        got = fingerprints.with_next(docs, blocks).select("doc_id", "text", "next_text").collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        # the order is one ring through all rows: each text follows as often as it stands
        assert Counter(r["next_text"] for r in got) == Counter(t for _, t in rows)
        assert sum(r["text"] == r["next_text"] for r in got) == 150


def test_likeness_of_many_paragraphs(spark):
    n = 40_000
    a = [f"paragraph {i}" for i in range(n)]
    texts = (a, a[: n // 2] + [f"other {i}" for i in range(n // 2)], [f"strange {i}" for i in range(n)], a[: n // 2])
    df = spark.createDataFrame([tuple("\n".join(t) for t in texts)], "a string, half string, none string, cut string")
    for x in df.columns:
        df = fingerprints.with_lanes(df, df[x], x)
    r = df.select(*[fingerprints.likeness(df.a, df[x]).alias(x) for x in ("half", "none", "cut")]).head()
    assert 0.3 < r["half"] < 0.7 and r["none"] < 0.4 and 0.5 < r["cut"] < 0.85


def check_shards(docs, rows, shards):
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return loads


def test_shards_of_odd_rows(spark):
    docs = odd_docs(spark, 60)
    check_shards(docs.collect(), sharding.kd_shards(docs, shards=5).collect(), 5)
    check_shards(docs.collect(), sharding.kd_shards(docs, shards=1).collect(), 1)


def homes_of(rows):
    homes = defaultdict(set)
    for r in rows:
        homes[(r["text_crc32"], r["size"])].add(r["shard"])
    return homes


def test_shards_balance_and_keep_copies(spark):
    hot = [(i, "hot text " * 10, None, None, 0, None, 0) for i in range(1500)]
    rest = [(10_000 + i, f"text {i % 900} " * (1 + i % 11), None, None, 0, None, 0) for i in range(3000)]
    docs = spark.createDataFrame(hot + rest, DOCS)
    rows = sharding.kd_shards(docs, shards=13).collect()
    loads = check_shards(docs.collect(), rows, 13)
    mean = sum(loads.values()) / 13
    assert len(loads) == 13 and max(loads.values()) < 1.05 * mean and min(loads.values()) > 0.95 * mean
    hot_key = (zlib.crc32(("hot text " * 10).encode()), len("hot text " * 10) + 16)
    homes = homes_of(rows)
    assert len(homes.pop(hot_key)) > 1
    assert all(len(v) == 1 for v in homes.values())


def test_groups_near_a_cut_stay_together(spark):
    # every text has 12 copies: 10 % of a shard
    docs = spark.createDataFrame([(i, f"text {i % 300} " * 4, None, None, 0, None, 0) for i in range(3600)], DOCS)
    rows = sharding.kd_shards(docs, shards=30).collect()
    loads = check_shards(docs.collect(), rows, 30)
    mean = sum(loads.values()) / 30
    assert all(len(v) == 1 for v in homes_of(rows).values())
    assert len(loads) == 30 and max(loads.values()) < 1.12 * mean and min(loads.values()) > 0.88 * mean


def test_null_and_repeated_ids_share_a_text(spark):
    docs = spark.createDataFrame([(None if i % 2 else 5, "same text", None, None, 0, None, 0) for i in range(400)], DOCS)
    loads = check_shards(docs.collect(), sharding.kd_shards(docs, shards=4).collect(), 4)
    assert len(loads) == 4 and max(loads.values()) < 1.1 * sum(loads.values()) / 4


def brute_tree(rows, shards):
    """Shard of every row, cut by cut over sorted lists of points; no text is larger than a shard."""
    dims, target = 4, sum(r["size"] for r in rows) / shards
    point = lambda r, d: (r[f"d{d}"] << sharding.TEXT_BITS) + r["text_hash"]
    out = {}

    def place(part, first, k):
        if k == 1 or len(part) < 2:
            out.update({r["row_hash"]: first for r in part})
            return
        total = sum(r["size"] for r in part)
        wide = sorted(range(dims - 1), key=lambda d: (min(r[f"d{d}"] for r in part) - max(r[f"d{d}"] for r in part), d)) + [dims - 1]
        best = None
        for d in wide:
            per = Counter()
            for r in part:
                per[point(r, d)] += r["size"]
            upto = 0
            for p in sorted(per):
                if upto + per[p] >= total * (k // 2) / k:
                    break
                upto += per[p]
            for end in (p, p + 1):
                lower = [r for r in part if point(r, d) < end]
                size = sum(r["size"] for r in lower)
                left = round(k * size / total)
                if len(part) >= k:
                    left = min(max(left, k - (len(part) - len(lower))), len(lower))
                left = min(max(left, 1), k - 1)
                off = max(abs(size / left - total / k), abs((total - size) / (k - left) - total / k)) / target
                if best is None or off < best[0]:
                    best = (off, d, end, left)
            if best[0] <= sharding.UNEVEN:
                break
        _, d, end, left = best
        place([r for r in part if point(r, d) < end], first, left)
        place([r for r in part if point(r, d) >= end], first + left, k - left)

    place(rows, 0, shards)
    return out


def test_shards_against_a_tree_over_lists(spark):
    docs = spark.createDataFrame([(i, f"text {i % 70} é\n" * (1 + i % 9) + "x" * (i % 5) * 40, None, None, 0, None, 0) for i in range(700)], DOCS)
    with Stages(spark) as stages:
        narrow = stages.cut(sharding.narrow_of(docs))
        got = sharding.partitioned(narrow, 11, stages, light=0.0).collect()
        want = brute_tree(narrow.collect(), 11)
    assert {r["row_hash"]: r["node"] for r in got} == want
