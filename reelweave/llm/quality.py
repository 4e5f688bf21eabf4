"""Document quality by hierarchical empirical Bayes.

Evidence of the document: a logistic regression on the shapes of its words. Letters
become their kind (upper, lower, digit, or the sign itself) and repeats one, so "Word,"
and "THESE!!" have the shapes "Ul," and "U!"; a text is the share of each hashed shape among
its words, words of any length read whole. It is trained in numpy on a bounded sample (at most
``PER_CLASS`` labelled documents of each kind).

Evidence of the site: labels are counted per path (host and first directory of the
source), per host, and over all. A host's rate of good documents is shrunk to the global
rate, a path's to its host's: a rate is ``(good + strength * above) / (n + strength)``,
and the strengths come from the spread between hosts and between paths by the method of
moments, so sparse sites say little and large ones speak for themselves. All of it is
grouped aggregation of counts.

Score: the document's log odds plus the path's log odds over the global ones. A document
is rejected below ``REJECT``, which asks for clear evidence, so that clean documents of
poor sites stay.

Nulls: a null or empty text has no evidence of its own (log odds 0 over the global rate).
Null sources are one site. Null labels are not counted; without labels of both kinds all
scores are the global rate, or 0.5. A score of exactly ``REJECT`` is kept. Repeated rows get equal rows; an empty table gives
none. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelweave.llm.common import bounded_batches, cut_lineage, held_out, labelled_sample, labels_of
from reelweave.llm.words import WordTable, runs, with_number

PER_CLASS = 1500
SHAPES = 1 << 11
REJECT = 0.15
#: Strengths are kept within these.
#: Names of columns added to documents on the way.
EVIDENCE, SCORE, PATH, RATE = "_llm_evidence", "_llm_score", "_llm_path", "_llm_rate"
WEAKEST, STRONGEST = 2.0, 1e4


def site(source: Column) -> tuple[Column, Column]:
    """Host and path of a source: a URL or a bare name."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?#]*)", 1))
    path = F.regexp_extract(bare, r"^[^/?#]*(/[^/?#]*)", 1)
    return host, F.concat(host, path)


def shapes(words: list[str]) -> np.ndarray:
    """Hashed shape of each word."""
    points = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    some, where = np.unique(points, return_inverse=True)

    def kind(c: str) -> int:
        return 1 if c.isalpha() and c.lower() == c else 2 if c.isalpha() else 3 if c.isdigit() else 0 if c == " " else 4 + ord(c)

    kinds = np.array([kind(chr(int(p))) for p in some], dtype=np.int64)[where]
    number = np.cumsum(points == 32)
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = (kinds[1:] != kinds[:-1]) | (number[1:] != number[:-1])
    kinds, number = kinds[fresh & (kinds > 0)], number[fresh & (kinds > 0)]
    # a word's shape is the polynomial of its kinds modulo 2 ** 64, however many there are
    h = np.zeros(len(words), dtype=np.uint64)
    if len(number):
        begins = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        place = np.arange(len(number)) - np.repeat(begins, np.diff(np.r_[begins, len(number)]))
        power = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
        h[number[begins]] = np.add.reduceat((kinds.astype(np.uint64) + np.uint64(1)) * power[place], begins)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(20)) % np.uint64(SHAPES)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: Log odds of a good document among the labelled.
    prior: float

    def words(self) -> WordTable:
        return WordTable(lambda w: np.stack([self.weights[shapes(w)], np.ones(len(w))], axis=1), 2)

    def evidence(self, words: WordTable, texts: list[str | None]) -> np.ndarray:
        """Log odds of each document over the prior's."""
        sums = words.sums([(t or "").split() for t in texts])
        return np.where(sums[:, 1] > 0, sums[:, 0] / np.maximum(sums[:, 1], 1) + self.bias, 0.0)


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Label, shapes and their counts of the documents learned from.

    Texts become counts where they lie, so at most 2 * PER_CLASS rows of at most SHAPES
    numbers arrive.
    """
    names = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("shape", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in runs(batch.column("text").to_pylist()):
                index: dict[str, int] = {}
                cut = [np.array([index.setdefault(w, len(index)) for w in t.split()], dtype=np.int64) for t in part]
                shape = shapes(list(index)) if index else np.zeros(0, np.int64)
                found = [np.unique(shape[c], return_counts=True) for c in cut]
                held = [batch.column(c).slice(start, len(part)) for c in ("doc_id", "label")]
                yield pa.record_batch([*held, pa.array([x.astype(np.int32) for x, _ in found], names.field("shape").type), pa.array([n.astype(np.int32) for _, n in found], names.field("n").type)], schema=names)

    texts = labelled_sample(docs, labels, "quality", PER_CLASS).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    table = bounded_batches(texts).mapInArrow(count, "doc_id long, label int, shape array<int>, n array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    shape, n = (table.column(c) for c in ("shape", "n"))
    return [(label, a.values.to_numpy(), b.values.to_numpy()) for label, a, b in zip(table.column("label").to_pylist(), shape, n)]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Logistic regression with classes of equal weight, so its log odds are over the prior's.

    ``rows`` have the label, the shapes and their counts of a document; only shapes that
    occur are held.
    """
    y = np.array([r[0] for r in rows], dtype=np.float64)
    model = Model(np.zeros(SHAPES), 0.0, 0.0)
    if len(set(y.tolist())) < 2:
        return model
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    shape = np.concatenate([r[1] for r in rows])
    n = np.concatenate([r[2] for r in rows])
    share = n / np.bincount(row, weights=n, minlength=len(rows))[row]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    speed, pace = np.full(SHAPES, 1e-12), 1e-12
    for _ in range(steps):
        sums = np.bincount(row, weights=share * model.weights[shape], minlength=len(rows))
        p = 1 / (1 + np.exp(-np.clip(sums + model.bias, -30, 30)))
        off = weight * (y - p)
        slope = np.bincount(shape, weights=share * off[row], minlength=SHAPES) - ridge * model.weights
        speed += slope**2
        pace += off.sum() ** 2
        model.weights += rate * slope / np.sqrt(speed)
        model.bias += rate * off.sum() / np.sqrt(pace)
    return model


def strength(rates: DataFrame, n: str, good: str, above: Column) -> float:
    """Pseudo-counts by the method of moments: how far groups of ``n`` spread beyond chance.

    ``rates`` has a row per group; sums over it give the spread around ``above``.
    """
    r = F.col(good) / F.col(n)
    chance = above * (1 - above)
    row = rates.agg(
        F.sum(F.col(n) * (r - above) * (r - above)).alias("spread"), F.sum(chance).alias("chance"), F.sum(F.col(n) * chance).alias("mass"), F.count("*").alias("k"), F.sum(n).alias("n")
    ).head()
    if not row["k"] or not row["mass"] or not row["n"]:
        return STRONGEST
    # E[spread] = sum chance * (1 + (n - 1) * rho), rho = 1 / (strength + 1)
    rho = (row["spread"] - row["chance"]) / max(row["mass"] - row["chance"], 1e-12)
    return float(min(STRONGEST, max(WEAKEST, 1 / rho - 1))) if rho > 0 else STRONGEST


def sites(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Rates per path, shrunk to host and globe: ``path, host_rate, path_rate``; the global rate."""
    host, path = site(F.col("source"))
    every = docs.select("doc_id", host.alias("host"), path.alias("path"))
    counted = every.join(labels_of(labels, "quality"), "doc_id", "left")
    paths = cut_lineage(counted.groupBy("host", "path").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_good")).head()
    rate = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.5
    a = strength(hosts.where("host_n > 0"), "host_n", "host_good", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + a * rate) / (F.col("host_n") + a))
    paths = paths.join(hosts.select("host", "host_rate"), "host")
    b = strength(paths.where("n > 0"), "n", "good", F.col("host_rate"))
    paths = paths.withColumn("path_rate", (F.col("good") + b * F.col("host_rate")) / (F.col("n") + b))
    return cut_lineage(paths.select("path", "host_rate", "path_rate")), rate


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    model = fit(sample(docs, labels))
    rates, rate = sites(docs, labels)
    model.prior = float(np.log(rate / (1 - rate)))
    return model, rates


def _evident(docs: DataFrame, model: Model) -> DataFrame:
    def scorer():
        words = model.words()
        return lambda texts: model.evidence(words, texts)

    return with_number(docs, EVIDENCE, scorer)


def _posterior(rows: DataFrame, rate: str = "path_rate") -> DataFrame:
    odds = F.col(EVIDENCE) + F.log(F.col(rate) / (1 - F.col(rate)))
    return rows.withColumn(SCORE, 1 / (1 + F.exp(-odds)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, evidence, host_rate, path_rate, score, rejected`` of every document."""
    model, rates = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), site(F.col("source"))[1].alias("path"), "text")
    rows = _posterior(_evident(rows, model).drop("text").join(rates, "path"))
    score = F.col(SCORE)
    return rows.select("doc_id", "held_out", F.col(EVIDENCE).alias("evidence"), "host_rate", "path_rate", score.alias("score"), (score < REJECT).alias("rejected"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns unchanged."""
    model, rates = learn(docs, labels)
    rates = rates.select(F.col("path").alias(PATH), F.col("path_rate").alias(RATE))
    # the documents' own columns may have any names but the reserved ones
    rows = _evident(docs, model).withColumn(PATH, site(F.col("source"))[1])
    rows = _posterior(rows.join(rates, PATH), RATE)
    return rows.where(F.col(SCORE) >= REJECT).select(*[F.col(f"`{c}`") for c in docs.columns])
