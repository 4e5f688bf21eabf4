"""Language, quality and toxicity: held-out figures, brute force, odd tables; the pipeline."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelweave.llm import bpe, language, mixing, near_dup, quality, queries, toxicity
from reelweave.llm.common import cut_lineage

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label int, path int"
LABELS = "doc_id long, quality int, toxic int, text string"


def odd_tables(spark):
    rows = [(1, "hello world", "en", "a", 1, "x", 1, 1), (2, None, None, None, None, None, None, None), (3, "", "en", "", 0, "x", 1, 1), (None, "123 ... !!", "en", "http://a.b/c/d", 1, "x", 1, 1)]
    rows += [(4, "bonjour le monde " * 20_000, "fr", "a", 1, "x", 1, 1), (5, "hello world", "en", "a", 1, "x", 1, 1), (5, "hello world", "en", "a", 1, "x", 1, 1), (6, "x", "en", "a", 1, "x", 1, 1)]
    labels = [(1, 1, 0, "x"), (1, 0, 0, "x"), (2, None, None, "x"), (None, 1, 1, "x"), (4, 0, 1, "x"), (99, 1, 1, "x")]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_odd_tables(spark):
    docs, labels = odd_tables(spark)
    for rows in (language.identified(docs), quality.judged(docs, labels), toxicity.tagged(docs, labels)):
        got = rows.collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
        assert all(0 <= r["score"] <= 1 for r in got)
    named = {r["doc_id"]: r for r in language.identified(docs).collect()}
    assert named[2]["lang_pred"] == named[3]["lang_pred"] == named[None]["lang_pred"] == "und" and named[2]["score"] == 0
    assert named[1]["lang_pred"] in ("en", "fr")


def test_empty_and_unlabelled_tables(spark):
    docs, labels = odd_tables(spark)
    none, nothing = docs.where("false"), labels.where("false")
    assert language.identified(none).collect() == quality.judged(none, labels).collect() == toxicity.tagged(none, labels).collect() == []
    assert {r["score"] for r in quality.judged(docs, nothing).collect()} == {0.5}
    assert {r["predicted"] for r in toxicity.tagged(docs, nothing).collect()} == {0}
    assert {r["lang_pred"] for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op2_subword_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert np.mean([r["rejected"] for r in rows]) < 0.02


def test_predictions_do_not_see_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = language.fit([("a", False, *np.unique(language.grams(["abc", "abd"])[0], return_counts=True)), ("b", True, *np.unique(language.grams(["xyz"])[0], return_counts=True))])
    a = language.predicted(docs, model).select("doc_id", "lang_pred", "score").collect()
    b = language.predicted(docs.withColumn("lang", F.lit("z")).withColumn("source", F.lit("q")), model).select("doc_id", "lang_pred", "score").collect()
    assert Counter(a) == Counter(b)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.QUERIES["op8_site_quality"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = [r["rejected"] for r in rows if r["quality"] == 1]
    bad = [r["rejected"] for r in rows if r["quality"] == 0]
    assert np.mean(good) < 0.03 and np.mean(bad) > 0.4


def test_quality_learns_from_counts_in_little_memory(spark):
    import tracemalloc

    docs = spark.createDataFrame([(i, f"Word {'THESE!! ' * i}a1", "en", "a", 1, "x", 1, 1) for i in range(40)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)], LABELS)
    texts = sorted(quality.labelled_sample(docs, labels, "quality", quality.PER_CLASS).collect(), key=lambda r: r["doc_id"])
    rows = quality.sample(docs, labels)
    assert len(rows) == len(texts) > 20
    for (label, shape, n), r in zip(rows, texts):
        assert label == r["label"] and dict(zip(shape, n)) == Counter(quality.shapes(r["text"].split()))
    rng = np.random.default_rng(1)
    many = [(i % 2, np.sort(rng.choice(quality.SHAPES, 40, replace=False)), rng.integers(1, 9, 40)) for i in range(2 * quality.PER_CLASS)]
    tracemalloc.start()
    model = quality.fit(many, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and peak < 16 << 20


def test_sites_shrink_to_their_parents(spark):
    rows, labels = [], []
    for i in range(400):
        site = "http://big.org/a/x" if i < 300 else f"http://small{i}.org/p"
        rows.append((i, "plain text", "en", site, 1, "x", 1, 1))
        labels.append((i, int(i % 10 != 0) if i < 300 else int(i % 2), 0, "x"))
    rates, globe = quality.sites(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    got = {r["path"]: r for r in rates.collect()}
    assert len(got) == 101
    assert abs(got["big.org/a"]["path_rate"] - 0.9) < 0.05
    for path, r in got.items():
        if path.startswith("small"):
            assert 0.05 < r["path_rate"] < 0.95 and abs(r["path_rate"] - globe) < 0.5


def brute_marginals(e, opening, passing):
    n = len(e)
    weight = {}
    for s in itertools.product((0, 1), repeat=n):
        z = opening[s[0]] + sum(e[t] * s[t] for t in range(n)) + sum(passing[s[t - 1], s[t]] for t in range(1, n))
        weight[s] = np.exp(z)
    total = sum(weight.values())
    m = [sum(w for s, w in weight.items() if s[t]) / total for t in range(n)]
    pairs = np.zeros((2, 2))
    for s, w in weight.items():
        for t in range(1, n):
            pairs[s[t - 1], s[t]] += w / total
    return np.array(m), pairs


@pytest.mark.parametrize("block", [2, 3, 128])
def test_forward_backward_against_all_paths(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(4)
    opening, passing = rng.normal(size=2), rng.normal(size=(2, 2))
    sizes = [1, 7, 2, 5, 1, 1, 9]
    parts = [rng.normal(size=n) * 3 for n in sizes]
    starts = np.cumsum(sizes) - sizes
    m, pairs = toxicity.forward_backward(np.concatenate(parts), starts, opening, passing)
    want = [brute_marginals(e, opening, passing) for e in parts]
    assert np.allclose(m, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op9_crf_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.03


def test_toxic_spans_are_offsets():
    text = "a  bad,\nbad word"
    assert toxicity.spans(text, np.array([0.1, 0.9, 0.8, 0.2])) == [(3, 11)]
    assert toxicity.spans(None, np.zeros(0)) == []


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = cut_lineage(stage(spark, rows, sf))
        assert rows.schema == docs.schema, name
        sizes.append(rows.count())
    assert sizes[1] > 0.97 * sizes[0] and sizes[2] > 0.7 * sizes[1] and sizes[3] <= sizes[2]
    assert not near_dup.grouped(rows.dropDuplicates(["doc_id"])).where("NOT kept").count()
    want = Counter(tuple(r) for r in bpe.encoded(rows, with_ids=False).collect())
    got = corpus_pipeline.run(spark, sf)
    assert Counter(tuple(r) for r in got.drop("ids").collect()) == want
    assert mixing.mix_table(docs).count() == sizes[0]


def test_every_letter_of_a_long_token_counts():
    from reelweave.llm import toxicity

    assert toxicity.tokens("a b") == ["a", "b"]
    long = "x" * 24 + "idiot"
    assert toxicity.tokens(f"say {long} now") == ["say", "x" * 24, "idiot", "now"]
    joined = "、".join(["word"] * 9)
    assert toxicity.tokens(joined) == ["word", "、"] * 8 + ["word"]
    for text in ("", " \t\n", joined, f"  {long}{long}!!{long}  \x1c é", "word " * 3 + "-" * 100):
        assert [text[a:b] for a, b in toxicity.places(text)] == toxicity.tokens(text)
        assert "".join(toxicity.tokens(text)) == "".join(text.split())
    other = "x" * 24 + "table"
    assert [tuple(r) for r in toxicity.features(toxicity.tokens(long))] != [tuple(r) for r in toxicity.features(toxicity.tokens(other))]
    hits = np.array([False, False, True, False])
    assert toxicity.spans(f"say {long} now", hits.astype(float)) == [(28, 33)]


def test_every_change_of_kind_counts_in_a_shape():
    from reelweave.llm import quality

    same = "aB" * 10
    shapes = quality.shapes([same + "1", same + "!", same + "1", "Word", "Other", "WORD", "ABBA", "", "x" * 5, "xy", same * 5000])
    assert shapes[0] != shapes[1] and shapes[0] == shapes[2]
    assert shapes[3] == shapes[4] != shapes[5] == shapes[6] and shapes[8] == shapes[9] != shapes[3]


def test_least_hashes_are_the_same_with_and_without_a_cutoff(spark):
    from pyspark.sql import Window

    from reelweave.llm.common import least_hashes

    ids = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label")).union(spark.createDataFrame([(9001, 7), (9002, 7)], "doc_id long, label int"))
    want = ids.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))).where("place <= 50")
    rows = lambda df: {(r["doc_id"], r["label"], r["place"]) for r in df.collect()}
    assert rows(least_hashes(ids, 50)) == rows(want)
    assert least_hashes(ids.limit(0), 50).count() == 0
