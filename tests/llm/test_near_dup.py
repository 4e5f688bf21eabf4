"""SetSketch groups against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelweave.llm import near_dup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for v in by.values():
        for p, i in enumerate(v):
            for j in v[p + 1 :]:
                shared[i, j] += 1
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(s), min(least[find(i)], default=None), d == min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, b"x", 0) for d, t in rows], "doc_id long, text string, class binary, band int")
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.grouped(df).collect())


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 300))]
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 18))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    for _ in range(60):  # a passage that many share
        rows.append(" ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(1, 120))]))
    chain = [rng.choice(vocab) for _ in range(200)]
    for i in range(20):  # a drift whose ends are not linked
        chain[10 * i : 10 * i + 3] = [rng.choice(vocab) for _ in range(3)]
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_against_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (5, "ONE two"), (6, "one  two\x0bthree"), (7, "Ä b c d e"), (8, "ä b c d e"), (9, "word " * 20_000), (10, "word word word word word"), (11, "a b c d e"), (12, "a b c d e")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()


def test_null_ids_join_groups(spark):
    got = run(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u v w")])
    assert got == Counter({(None, 2, 3, False): 1, (3, 2, 3, True): 1, (None, 3, None, True): 1})


def test_kept_documents(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, _gone int")
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    want = {d for d, _, _, k in brute(rows) if k}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_one_row_of_each_group_stays(spark):
    def text(name, *changed):
        return " ".join(f"{name}{i}" if i not in changed else f"other{i}" for i in range(80))

    rows = [(None, text("a")), (None, text("a")), (None, text("a", 79)), (1, text("b")), (1, text("b")), (2, text("b", 79)), (None, text("b"))]
    rows += [(5, text("c")), (5, text("d")), (4, text("d", 0)), (7, text("e")), (None, ""), (None, ""), (8, ""), (8, None), (9, " "), (6, "f g h"), (6, "i j k")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _class0 int")
    kept = near_dup.deduplicated(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], shingles(r["text"])) for r in kept.collect()]
    a = [s for d, s in got if d is None and s]
    assert len(a) == 1 and a[0] in (shingles(text("a")), shingles(text("a", 79)))
    want = [(1, text("b")), (5, text("c")), (4, text("d", 0)), (7, text("e")), (None, ""), (None, ""), (8, ""), (9, ""), (6, "f g h"), (6, "i j k")]
    assert Counter(x for x in got if x[0] is not None or not x[1]) == Counter((d, shingles(t)) for d, t in want)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 6000).astype(np.uint64))
    assert (near_dup.merged(near_dup.registers(a[:100]), near_dup.registers(a[100:])) == near_dup.registers(a)).all()
    for share in (0.3, 0.75, 0.95):
        n = 1000
        k = int(2 * n * share / (1 + share))
        x, y = a[:n], np.concatenate([a[:k], a[n : 2 * n - k]])
        est = near_dup.likeliest(near_dup.registers(x)[None], near_dup.registers(y)[None], np.array([float(n)]), np.array([float(n)]))
        assert abs(est[0] - share) < 0.17
