"""BPE encoding and decoding with a pair occurrence index.

The vocabulary and merges come from a tokenizer file (JSON) named by path; nothing is
trained. Words of a partition are encoded together: every pair of neighbouring symbols
is mapped to all its positions in the partition's new words, ranks that occur are taken
in ascending order from a heap, each merge rewrites all its positions at once and moves
the pairs beside them to other lists. A merge only ever creates pairs with a higher
rank, so ascending order over all words equals lowest-rank-first within each word; a
pair whose rank were lower is put on the heap again and handled all the same.

Words already seen in the partition are kept with their ids as bytes, up to ``KEPT_WORDS``; then
the memory starts anew. Memory is bounded by one batch of texts plus that, and a task leaves none of
it to the worker that goes on with tasks of other stages.

Which characters are letters comes from the ``regex`` package's Unicode tables; of the
characters assigned in Unicode 15 all libraries agree.

Null texts count as empty: no ids, and the hashes of nothing. Repeated rows give equal
rows, an empty table none. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.llm.common import bounded_batches

#: White space of the file's patterns (the Unicode property; the four ASCII separators,
#: which Python adds, do not belong to it), as the inside of a character class.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = regex.compile(f"[{WHITE}]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")

KEPT_WORDS = 200_000
#: Characters of text handled at once.
BATCH_CHARS = 2_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for letters from 256 on, in order.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, as its JSON file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        #: Rank to left symbol, right symbol and what they become.
        self.rules: list[tuple[int, int, int]] = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rules.append((self.vocab[a], self.vocab[b], self.vocab[a + b]))
        self.base = max(self.vocab.values()) + 3
        codes = np.array([(a + 2) * self.base + b + 2 for a, b, _ in self.rules], dtype=np.int64)
        self.code_rank = np.argsort(codes, kind="stable")
        self.codes = codes[self.code_rank]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.letter = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.suffix) for c in letters]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}"), flags=regex.V0)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: Ids of words, and of runs of words without white space, met so far, as little-endian numbers of 32 bits.
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.forget()

    # text to words

    @staticmethod
    def normal(text: str) -> str:
        """Canonical composition, lower case letter by letter; white space is cut later."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # a final sigma is no rule of single letters
                return "".join("σ" if c == "Σ" else c.lower() for c in text)
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Runs without white space; special tokens stand between them after a blank."""
        if self.marks is None or "<|" not in text:
            return self.runs(text)
        out: list[str] = []
        for part in self.marks.split(text):
            if part in self.special:
                out.append(" " + part)
            elif part:
                out += self.runs(part)
        return out

    def runs(self, text: str) -> list[str]:
        text = self.normal(text)
        if not _SEPARATOR.search(text):
            return text.split()
        return [c for c in _SPACE.split(text) if c]

    # words to ids

    def learn(self, chunks: Iterable[str]) -> None:
        """Encode the words of the chunks that are not yet known, all together."""
        words = self.words
        parts = {c: self.split.findall(c) for c in chunks}
        fresh = list({w for ws in parts.values() for w in ws if w not in words})
        words.update(zip(fresh, self.merge_all(fresh)))
        known = self.known
        for c, ws in parts.items():
            known[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 where there is no merge."""
        code = (left + 2) * self.base + right + 2
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], -1)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Ids of each word, by the pair occurrence index over all words."""
        symbols: list[int] = []
        for w in words:
            raw = w.encode("utf-8")
            ids = [self.letter[c] for c in raw[:-1]] + [self.last[raw[-1]]]
            symbols += [i for i in ids if i is not None]
            symbols.append(-1)  # a wall between words: in no pair
        n = len(symbols)
        sym = np.array(symbols + [-1], dtype=np.int64)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)  # before the first stands the last, which is a wall
        index: dict[int, list[np.ndarray]] = {}

        def note(ranks: np.ndarray, positions: np.ndarray) -> list[int]:
            """Append positions to the lists of their ranks; returns ranks without a list."""
            some = ranks >= 0
            ranks, positions = ranks[some], positions[some]
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            new = []
            for r, where in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], np.split(positions, cuts)):
                if r not in index:
                    index[r] = []
                    new.append(r)
                index[r].append(where)
            return new

        heap = note(self.ranks_of(sym[:-1], sym[1:]), np.arange(n))
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = self.rules[rank]
            where = index.pop(rank)
            p = where[0] if len(where) == 1 else np.unique(np.concatenate(where))
            p = p[(sym[p] == a) & (sym[after[p]] == b)]  # others have merged away meanwhile
            if a == b and len(p) > 1:  # overlapping pairs merge from the left
                p = self.apart(p, after)
            if not len(p):
                continue
            q = after[p]
            following = after[q]
            sym[p], sym[q] = new, -2
            after[p], before[following] = following, p
            prior = before[p]
            ranks = self.ranks_of(np.concatenate([sym[p], sym[prior]]), np.concatenate([sym[following], sym[p]]))
            for r in note(ranks, np.concatenate([p, prior])):
                heapq.heappush(heap, r)
        sym = sym[:n]
        sym = sym[sym != -2]
        walls = np.flatnonzero(sym == -1)
        flat = sym.astype("<u4").tobytes()
        out, start = [], 0
        for end in walls.tolist():
            out.append(flat[4 * start : 4 * end])
            start = end + 1
        return out

    @staticmethod
    def apart(p: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of ascending positions, those that do not begin inside the pair taken before."""
        taken, end = [], -1
        for x, nxt in zip(p.tolist(), after[p].tolist()):
            if x != end:
                taken.append(x)
                end = nxt
            else:
                end = -1
        return np.array(taken, dtype=np.int64)

    def forget(self) -> None:
        self.words = {}
        self.known = {" " + t: i.to_bytes(4, "little") for t, i in self.special.items()}

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.forget()
        unknown = set().union(*cut)
        unknown.difference_update(self.known)
        self.learn(unknown)
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, c)), dtype="<u4") for c in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens side by side with a blank between: the file names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def encoded(docs: DataFrame, *, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    ``vocabulary`` is a path on the executors; by default the installed public file.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary or vocabulary_path())
        try:
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                done = 0
                for run in _runs(texts):
                    ids = bpe.encode_batch(run)
                    keys = batch.column("doc_id").slice(done, len(run))
                    done += len(run)
                    columns = [
                        keys,
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids]),
                        pa.array([hashlib.sha256(bpe.decode(i.tolist()).encode()).hexdigest() for i in ids]),
                    ]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
        finally:  # also where the rows are not read to the end
            bpe.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(tasks, schema)
