"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs without white space; one of more than ``LETTERS`` characters is cut between
letters and signs and into pieces of that length, so that every character of a text of any length
is looked at. Each token is inside a toxic span or not. Emission scores are sums of weights
of hashed features of the token (the word and its first 4 to 6 letters, lower case and
without punctuation at the ends); a 2 x 2 table scores neighbouring states. Marginals come
from forward-backward. Their sum, maximum and density go through a logistic function
fitted to document labels, which gives the document's score; runs of tokens with a
marginal of at least one half are the offending spans.

Labelled tokens. Labels are given per document, so tokens of the sample are labelled from
them first: a token of a toxic document counts as toxic if one of its features is found in
toxic documents and hardly in others (``LIFT`` times as often, in ``SUPPORT`` of them).
The field is trained on those by gradient ascent on its likelihood in numpy. The sample
has at most ``PER_CLASS`` documents of each label; every fourth calibrates and is not
trained on.

Forward-backward over all texts of a batch runs as one chain whose links at the starts of
texts forget what came before. The chain is cut into blocks that advance side by side, so
each step is one vector operation; results are those of the sequential recursion.

Nulls: null and empty texts have no tokens, no spans and the score of an empty text. Null
labels are not learned from; without labels of both kinds the score is the share of toxic
labels, or 0. Repeated rows get equal rows; an empty table gives none. A marginal of exactly
one half is toxic, and so is a score of exactly one half. Labels, lang, source
and id are no inputs of a score. Other columns do not matter.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm.common import held_out, labelled_sample
from reelweave.llm.words import WordTable, with_columns

#: Documents learned from per label, at most.
PER_CLASS = 1500
BUCKETS = 1 << 18
#: Letters of a token at most; what is longer is cut into pieces.
LETTERS = 24
PREFIXES = (4, 5, 6)
LIFT = 20.0
SUPPORT = 4
STEPS = 40
RATE = 0.5
RIDGE = 1e-4
#: Tokens per block of the chain.
BLOCK = 128
#: Tokens trained on at once, about.
CHAIN = 150_000
WORDS_AT_ONCE = 50_000
ENDS = string.punctuation + "«»“”„‘’…¡¿–—"


_PIECE = re.compile(r"[^\W_]{1,%d}|[\W_]{1,%d}" % (LETTERS, LETTERS))


def pieces(word: str) -> list[str]:
    """A token, or the pieces of one that is too long: cut between letters and signs, then by length."""
    return [word] if len(word) <= LETTERS else _PIECE.findall(word)


def tokens(text: str) -> list[str]:
    """All tokens of a text; every character that is no white space is in one."""
    words = text.split()
    if all(len(w) <= LETTERS for w in words):
        return words
    return [p for w in words for p in pieces(w)]


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of every token."""
    out: list[tuple[int, int]] = []
    at = 0
    for token in tokens(text):
        at = text.index(token, at)
        out.append((at, at + len(token)))
        at += len(token)
    return out


def features(words: list[str]) -> np.ndarray:
    """Buckets of the features of each word: prefixes, then the word itself.

    A prefix longer than the word has the word's bucket of an unused kind, 0.
    """
    if len(words) > WORDS_AT_ONCE:
        return np.concatenate([features(words[i : i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)])
    bare = np.array([w.lower().strip(ENDS) for w in words], dtype=f"<U{LETTERS}")
    points = bare.view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    h = np.full(len(words), 0x1234567, dtype=np.uint64)
    out = np.zeros((len(words), len(PREFIXES) + 1), dtype=np.int64)
    for k in range(LETTERS):
        on = points[:, k] != 0
        if not on.any():
            break
        mixed = (h ^ points[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h = np.where(on, mixed ^ (mixed >> np.uint64(31)), h)
        if k + 1 in PREFIXES:
            at = (((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
            out[:, PREFIXES.index(k + 1)] = np.where(on, at, 0)
    whole = (((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    out[:, -1] = np.where(points[:, 0] != 0, whole, 0)
    return out


def _scan(links: np.ndarray) -> np.ndarray:
    """Normalised states after each link of a chain of 2 x 2 matrices, from (1, 1) / 2.

    ``links`` is (tokens, 2, 2); blocks of it advance side by side.
    """
    n = len(links)
    blocks = -(-n // BLOCK)
    padded = np.concatenate([links, np.broadcast_to(np.eye(2), (blocks * BLOCK - n, 2, 2))]).reshape(blocks, BLOCK, 2, 2)
    product = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    for s in range(BLOCK):
        product = product @ padded[:, s]
        product /= product.sum(axis=(1, 2), keepdims=True)
    state = np.array([0.5, 0.5])
    opening = np.empty((blocks, 2))
    for b in range(blocks):
        opening[b] = state
        state = state @ product[b]
        state = state / state.sum()
    out = np.empty((blocks, BLOCK, 2))
    state = opening
    for s in range(BLOCK):
        a = state[:, :1] * padded[:, s, 0] + state[:, 1:] * padded[:, s, 1]
        state = out[:, s] = a / a.sum(axis=1, keepdims=True)
    return out.reshape(-1, 2)[:n]


def forward_backward(emission: np.ndarray, starts: np.ndarray, opening: np.ndarray, passing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 per token, and expected counts (2, 2) of neighbouring states.

    ``emission`` is the score of state 1 over state 0; texts begin at ``starts``.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e = np.clip(emission, -30, 30)
    local = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], axis=1)
    step, begin = np.exp(passing - passing.max()), np.exp(opening - opening.max())
    links = step[None] * local[:, None, :]
    first = np.zeros(n, bool)
    first[starts] = True
    links[first] = begin[None, None, :] * local[first][:, None, :]
    alpha = _scan(links)
    # from the right: the state before token t is link t+1 times the state after it
    turned = np.concatenate([np.ones((1, 2, 2)), links[:0:-1].transpose(0, 2, 1)])
    beta = _scan(turned)[::-1]
    both = alpha * beta
    marginal = both[:, 1] / both.sum(axis=1)
    inner = np.flatnonzero(~first)
    pair = alpha[inner - 1][:, :, None] * links[inner] * beta[inner][:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return marginal, pair.sum(axis=0)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    opening: np.ndarray
    passing: np.ndarray
    #: Logistic function of a document: weights of its summary, and the intercept.
    summary: np.ndarray
    intercept: float

    def words(self) -> WordTable:
        return WordTable(lambda w: (self.weights[features(w)].sum(axis=1) + self.bias)[:, None], 1)

    def marginals(self, words: WordTable, texts: list[str | None]) -> list[np.ndarray]:
        rows = words.rows([tokens(t or "") for t in texts])
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        ends = np.cumsum(sizes)
        m, _ = forward_backward(words.table[np.concatenate(rows), 0] if ends[-1] else np.zeros(0), (ends - sizes)[sizes > 0], self.opening, self.passing)
        return np.split(m, ends[:-1])

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        z = np.array([summarised(m) for m in marginals]).reshape(len(marginals), 3) @ self.summary + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summarised(m: np.ndarray) -> tuple[float, float, float]:
    """Expected toxic tokens, the likeliest one, and their density."""
    return (float(np.log1p(m.sum())), float(m.max()), float(np.sqrt(m.mean()))) if len(m) else (0.0, 0.0, 0.0)


def _token_labels(feats: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Tokens of toxic documents with a feature that others hardly have."""
    seen = {0: np.zeros(BUCKETS), 1: np.zeros(BUCKETS)}
    for f, y in zip(feats, labels):
        seen[int(y)][np.unique(f)] += 1
    toxic, clean = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    lift = ((seen[1] + 0.05) / toxic) / ((seen[0] + 0.5) / clean)
    support = max(SUPPORT, int(0.008 * toxic))
    mark = (lift >= LIFT) & (seen[1] >= support)
    mark[0] = False
    return [mark[f].any(axis=1) & bool(y) for f, y in zip(feats, labels)]


def _first_of_copies(cut: list[np.ndarray], bands: int = 8) -> np.ndarray:
    """Which documents are no near copies of earlier ones, by banded minima of word triples.

    One text copied often would make every word of it look telling.
    """
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 2**63, size=2 * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple[int, int, int]] = set()
    keep = np.ones(len(cut), bool)
    for i, w in enumerate(cut):
        w = w.astype(np.uint64) + np.uint64(1)
        h = w if len(w) < 3 else (w[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (w[2:] * np.uint64(0x165667B19E3779F9))
        if not len(h):
            continue
        h ^= h >> np.uint64(32)
        least = (h[None, :] * odd[:, None]).min(axis=1).tolist()
        keys = {(b, least[2 * b], least[2 * b + 1]) for b in range(bands)}
        keep[i] = not keys & seen
        seen |= keys
    return keep


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method with a small ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    hold = np.eye(x.shape[1]) * ridge
    hold[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (y - p) - hold @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[int, str]]) -> Model:
    """The field from token labels, then the logistic function from held-back documents."""
    labels = np.array([y for y, _ in rows], dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(np.zeros(BUCKETS), -4.0, np.zeros(2), np.zeros((2, 2)), np.zeros(3), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if len(set(labels.tolist())) < 2:
        return model
    index: dict[str, int] = {}
    cut = [np.array([index.setdefault(w, len(index)) for w in tokens(text)], dtype=np.int64) for _, text in rows]
    single = np.flatnonzero(_first_of_copies(cut))
    rows, cut, labels = [rows[i] for i in single], [cut[i] for i in single], labels[single]
    held = np.arange(len(rows)) % 4 == 3
    table = features(list(index)) if index else np.zeros((0, len(PREFIXES) + 1), np.int64)
    learn = [i for i in range(len(rows)) if not held[i] and len(cut[i])]
    truth = _token_labels([table[cut[i]] for i in learn], labels[learn])
    chain = np.concatenate([cut[i] for i in learn]) if learn else np.zeros(0, np.int64)
    y = np.concatenate(truth).astype(np.float64) if truth else np.zeros(0)
    sizes = np.array([len(cut[i]) for i in learn], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.zeros(len(chain), bool)
    first[starts] = True
    seen_pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(seen_pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    pace = {n: 1e-6 for n in ("bias", "opening", "passing")}
    speed = np.full(BUCKETS, 1e-6)
    # forward-backward over so many documents at a time that memory stays small
    groups = np.split(np.arange(len(learn)), np.flatnonzero(np.diff(ends // CHAIN)) + 1) if learn else []
    for _ in range(STEPS):
        emission = model.weights[table].sum(axis=1) + model.bias
        m, pairs = np.empty(len(chain)), np.zeros((2, 2))
        for g in groups:
            part = slice(starts[g[0]], ends[g[-1]])
            m[part], seen = forward_backward(emission[chain[part]], starts[g] - starts[g[0]], model.opening, model.passing)
            pairs += seen
        # the gradient of the log likelihood: observed minus expected
        off = np.bincount(chain, weights=y - m, minlength=len(table))
        slope = np.zeros(BUCKETS)
        for k in range(table.shape[1]):
            slope += np.bincount(table[:, k], weights=off, minlength=BUCKETS)
        slope[0] = 0
        slope -= RIDGE * len(learn) * model.weights
        speed += slope**2
        model.weights += RATE * slope / np.sqrt(speed)
        begun = np.array([0.0, (y[starts] - m[starts]).sum()])
        for name, g in (("bias", (y - m).sum()), ("opening", begun), ("passing", seen_pairs - pairs)):
            pace[name] = pace[name] + np.square(g)
            setattr(model, name, getattr(model, name) + RATE * g / np.sqrt(pace[name]))
    words = model.words()
    judge = [i for i in range(len(rows)) if held[i]] or list(range(len(rows)))
    x = np.array([summarised(m) for m in model.marginals(words, [rows[i][1] for i in judge])])
    if len(set(labels[judge].tolist())) == 2:
        model.summary, model.intercept = _logistic(x, labels[judge].astype(np.float64))
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled_sample(docs, labels, "toxic", PER_CLASS).collect()  # at most 2 * PER_CLASS documents
    return fit([(r["label"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])


def spans(text: str | None, marginals: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Character offsets of runs of tokens whose marginal is at least ``least``."""
    on = marginals >= least
    if not on.any():
        return []
    out: list[tuple[int, int]] = []
    before = False
    for hit, (start, end) in zip(on.tolist(), places(text or "")):
        if hit and before:
            out[-1] = (out[-1][0], end)
        elif hit:
            out.append((start, end))
        before = hit
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the offending ``spans`` of every document."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def scorer():
        words = model.words()

        def score(texts: list[str | None]) -> dict[str, pa.Array]:
            m = model.marginals(words, texts)
            s = model.scores(m)
            found = [[{"start": a, "stop": b} for a, b in spans(t, x)] for t, x in zip(texts, m)]
            return {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32)), "spans": pa.array(found, span)}

        return score

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_columns(rows, scorer, "score double, predicted int, spans array<struct<start: bigint, stop: bigint>>")


def tagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learn(docs, labels))
