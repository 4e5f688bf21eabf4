"""Language identification by averaged hashed subword embeddings.

A text is the bag of the character n-grams (2 to 4) of its words, word ends included,
hashed to ``BUCKETS`` rows of an embedding table. Their average goes through a linear
softmax. Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample: at most ``PER_LANGUAGE`` labelled documents of each language,
those with the least hashes of their ids. Since the softmax is linear, embedding and
weights are multiplied out once for prediction, and words are scored once per task.

A part of the sample is not trained on but calibrates: a temperature scales the logits to
probabilities, and ``threshold`` is the score that all but ``REJECTED`` of the correctly
named texts reach (never above ``CEILING``). A document is rejected if its score stays
below it or it has no letter.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Null labels are not
learned from; without any label everything is ``und``. One known language gets score 1.
Repeated rows get equal rows; an empty table gives none. Labels, source and id are no
inputs of a prediction. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm.common import bounded_batches, cut_lineage, held_out, least_hashes
from reelweave.llm.words import WordTable, kept_rows, runs, with_columns

BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Documents learned from per language, at most.
PER_LANGUAGE = 600
EPOCHS = 8
BATCH = 32
RATE = 4.0
REJECTED = 0.001
CEILING = 0.5
UNKNOWN = "und"
WORDS_AT_ONCE = 20_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word of each."""
    points = np.frombuffer((" " + " ".join(words) + " ").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    number = np.cumsum(points == 32) - 1
    some, where = np.unique(points, return_inverse=True)
    letter = np.array([chr(int(p)).isalpha() for p in some], dtype=bool)[where]
    points = np.where(letter, points, np.uint64(0))
    buckets, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        hashed = np.full(len(points) - n + 1, n, dtype=np.uint64)
        inside = np.ones(len(hashed), bool)
        for k in range(n):
            part = slice(k, len(points) - n + 1 + k)
            hashed = (hashed ^ points[part]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            if 0 < k < n - 1:
                inside &= letter[part]
        if n == 2:  # a blank beside a letter, or two letters
            inside = letter[:-1] | letter[1:]
        at = np.flatnonzero(inside)
        buckets.append((hashed[at] >> np.uint64(32)).astype(np.int64) % BUCKETS)
        owners.append(number[at])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    #: Logits a bucket contributes before averaging, and the bias.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def words(self) -> WordTable:
        k = len(self.languages)

        def numbers(words: list[str]) -> np.ndarray:
            if len(words) > WORDS_AT_ONCE:
                return np.concatenate([numbers(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
            bucket, owner = grams(words)
            out = np.empty((len(words), k + 1))
            for c in range(k):
                out[:, c] = np.bincount(owner, weights=self.table[bucket, c], minlength=len(words))[: len(words)]
            out[:, k] = np.bincount(owner, minlength=len(words))[: len(words)]
            return out

        return WordTable(numbers, k + 1)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        total = np.maximum(sums[:, -1:], 1)
        logits = (sums[:, :-1] / total + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, words: WordTable, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums = words.sums([(t or "").split() for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = self.probabilities(sums)
        named = sums[:, -1] > 0
        best = p.argmax(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, named)]
        return names, np.where(named, p.max(axis=1), 0.0)


def sample(docs: DataFrame) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """Label, whether it calibrates, buckets and counts of the documents learned from.

    Which documents, is found from ids and labels alone; their texts become counts where
    they lie, so at most PER_LANGUAGE rows of at most BUCKETS numbers per language arrive.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").alias("label")).distinct()
    chosen = cut_lineage(least_hashes(ids, PER_LANGUAGE))
    texts = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    texts = texts.join(chosen, (texts.doc_id == chosen.doc_id) & (texts.lang == chosen.label)).select(chosen.doc_id, "label", "place", "text")
    texts = texts.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in runs(batch.column("text").to_pylist()):
                rows = {"doc_id": [], "label": [], "place": [], "bucket": [], "n": []}
                for i, text in enumerate(part):
                    bucket, n = np.unique(grams(text.split())[0], return_counts=True)
                    for name in ("doc_id", "label", "place"):
                        rows[name].append(batch.column(name)[start + i].as_py())
                    rows["bucket"].append(bucket.astype(np.int32))
                    rows["n"].append(n.astype(np.int32))
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", pa.int64()), ("label", pa.string()), ("place", pa.int32()), ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))

    table = bounded_batches(texts).mapInArrow(count, "doc_id long, label string, place int, bucket array<int>, n array<int>").toArrow()
    rows = []
    for label, place, doc_id, bucket, n in zip(*(table.column(c).to_pylist() if c in ("label", "place", "doc_id") else table.column(c) for c in ("label", "place", "doc_id", "bucket", "n"))):
        if len(bucket):
            rows.append((label, doc_id, place % 5 == 0, bucket.values.to_numpy(), n.values.to_numpy()))
    rows.sort(key=lambda r: (r[0], r[1], len(r[3])))
    return [(label, calibrates, bucket, n) for label, _, calibrates, bucket, n in rows]


def fit(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Stochastic gradient descent over embeddings and softmax, then calibration."""
    languages = sorted({r[0] for r in rows})
    k = len(languages)
    if k < 2:
        return Model(languages, np.zeros((BUCKETS, k)), np.zeros(k))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    learn = [r for r in rows if not r[1]] or rows
    steps = EPOCHS * -(-len(learn) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(learn))
        for at in range(0, len(order), BATCH):
            part = [learn[i] for i in order[at : at + BATCH]]
            some, inverse = np.unique(np.concatenate([r[2] for r in part]), return_inverse=True)
            share = np.zeros((len(part), len(some)))
            share[np.repeat(np.arange(len(part)), [len(r[2]) for r in part]), inverse] = np.concatenate([r[3] / r[3].sum() for r in part])
            hidden = share @ embedding[some]
            logits = hidden @ weights + bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(part)), [languages.index(r[0]) for r in part]] -= 1
            rate = RATE * (1 - step / steps)
            back = error @ weights.T
            weights -= rate * hidden.T @ error / len(part) * 4
            bias -= rate * error.mean(axis=0) * 0.1
            embedding[some] -= rate * share.T @ back
            step += 1
    model = Model(languages, embedding @ weights, bias)
    held = [r for r in rows if r[1]] or rows
    sums = np.array([np.append(model.table[r[2]].T @ r[3], r[3].sum()) for r in held])
    truth = np.array([languages.index(r[0]) for r in held])

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(sums)[np.arange(len(truth)), truth], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.01, 20, 153), key=loss)
    p = model.probabilities(sums)
    right = p.argmax(axis=1) == truth
    model.threshold = float(min(CEILING, np.quantile(p.max(axis=1)[right], REJECTED))) if right.any() else 0.0
    return model


def learn(docs: DataFrame) -> Model:
    return fit(sample(docs))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document."""

    def scorer():
        words = model.words()

        def score(texts: list[str | None]) -> dict[str, pa.Array]:
            names, scores = model.predict(words, texts)
            return {"lang_pred": pa.array(names), "score": pa.array(scores), "rejected": pa.array([n == UNKNOWN or bool(s < model.threshold) for n, s in zip(names, scores)])}

        return score

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_columns(rows, scorer, "lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents and name the language of all."""
    return predicted(docs, learn(docs))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, all columns unchanged."""

    def keep():
        words = model.words()

        def accept(texts: list[str | None]) -> np.ndarray:
            names, scores = model.predict(words, texts)
            return np.array([n != UNKNOWN and s >= model.threshold for n, s in zip(names, scores)], bool)

        return accept

    return kept_rows(docs, keep)
