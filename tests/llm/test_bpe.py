"""BPE against the tokenizers library."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reelweave.llm import bpe

PATH = bpe.vocabulary_path()
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.WordBpe(PATH)


def same(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "a", "aaaaaaa", "don't we'll I'M", "ΟΔΥΣΣΕΥΣ Σ", "İstanbul ǅ ﬀ", "é É", "<|startoftext|>hi<|endoftext|> <|endoftext|>x",
        "<|start<|endoftext|>oftext|>", "a\x1cb\x1fc\x85d e　f g\x0b\x0c\r\nh", "１２３ 123 ½", "😀😀👨‍👩‍👧 é", "\x00\x01￾\U0010ffff", " \x1c a", "x" * 3000, "ab " * 5000,
        "word<|endoftext|>́", "́ ́a", "'S'T''re", "a_b-c__d", "᠎​﻿ q",
    ],
)
def test_odd_texts(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):  # letters that Unicode added lately are letters to one library only
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeth insT'.,0 9é\n\tÄ<|endoftx>", max_size=80))
def test_common_letters(text):
    same(text)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = {r["doc_id"]: r for r in bpe.encoded(spark.read.parquet(path)).collect()}
    rows = pq.read_table(path).to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        ids = THEIRS.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids"] == ids
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(THEIRS.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "hello world", 3), (5, "hello world", 3)], "doc_id long, text string, ids int")
    rows = bpe.encoded(docs, with_ids=False).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 0, 2, 2]
    assert bpe.encoded(docs.where("false")).collect() == []


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    small = bpe.WordBpe(PATH)
    texts = ["one two three four", "two five six one", "seven one two"]
    assert [i.tolist() for i in small.encode_batch(texts)] == [OURS.encode(t) for t in texts]
    assert small.encode(texts[0]) == OURS.encode(texts[0])


def test_a_task_leaves_no_words_to_its_worker(spark):
    """Workers go on with tasks of other stages; what the tokens have met must not stay in them."""

    def held(batches):
        for _ in batches:
            words = bpe.load(PATH)
            yield pa.record_batch([pa.array([len(words.words) + len(words.known) - len(words.special)])], names=["n"])

    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), x -> concat('w', id * 100 + x))) AS text")
    assert bpe.encoded(docs).agg({"n_tokens": "sum"}).head()[0] > 20_000
    assert spark.range(0, 8, 1, 8).mapInArrow(held, "n long").agg({"n": "max"}).head()[0] == 0


def test_kept_words_are_bytes():
    words = bpe.WordBpe(PATH)
    words.encode("some words kept, <|endoftext|> and don't")
    assert all(isinstance(x, bytes) for x in [*words.words.values(), *words.known.values()])
