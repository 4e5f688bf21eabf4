"""Numbers per distinct word, remembered within a task and summed per text.

Models here score words independently, so a text's score is a sum over its words. A task
computes the numbers of words it has not met in one vectorised call per batch and keeps
them, up to ``KEPT_WORDS``; memory stays bounded and every text is read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelweave.llm.common import bounded_batches

KEPT_WORDS = 100_000
#: Characters of text handled at once.
BATCH_CHARS = 500_000


class WordTable:
    """``numbers(words) -> (len(words), width)`` behind a bounded memory."""

    def __init__(self, numbers: Callable[[list[str]], np.ndarray], width: int):
        self.numbers, self.width = numbers, width
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, self.width))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Row numbers in ``table`` of the words of each text."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        fresh = set().union(*texts)
        fresh.difference_update(self.index)
        if fresh:
            new = list(fresh)
            start = len(self.index)
            self.index.update(zip(new, range(start, start + len(new))))
            if len(self.index) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((len(self.index), self.width))])
            self.table[start : start + len(new)] = self.numbers(new)
        at = self.index.__getitem__
        return [np.fromiter(map(at, t), dtype=np.int64, count=len(t)) for t in texts]

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        rows = self.rows(texts)
        return np.array([self.table[r].sum(axis=0) for r in rows]).reshape(len(texts), self.width)


def runs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of bounded total length, with the number of the first."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def with_columns(docs: DataFrame, score: Callable[[list[str | None]], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``docs`` without its text, plus the columns ``score`` gives for the texts.

    ``score`` is made once per task by calling it with no argument.
    """
    kept = [c for c in docs.columns if c != "text"]
    types = docs.select(*[F.col(f"`{c}`") for c in kept]).schema

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = score()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            place = 0
            for _, part in runs([t or "" for t in texts]):
                got = scorer(texts[place : place + len(part)])
                rows = batch.slice(place, len(part))
                place += len(part)
                yield pa.RecordBatch.from_arrays([rows.column(c) for c in kept] + list(got.values()), kept + list(got))

    return bounded_batches(docs).mapInArrow(tasks, StructType(types.fields + StructType.fromDDL(schema).fields))


def kept_rows(docs: DataFrame, keep: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """Rows of ``docs``, all columns unchanged, whose text ``keep`` accepts."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = keep()
        at = docs_columns.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            mask: list[np.ndarray] = []
            place = 0
            for _, part in runs([t or "" for t in texts]):
                mask.append(accept(texts[place : place + len(part)]))
                place += len(part)
            yield batch.filter(pa.array(np.concatenate(mask) if mask else np.zeros(0, bool)))

    docs_columns = docs.columns
    return bounded_batches(docs).mapInArrow(tasks, docs.schema)


def with_number(docs: DataFrame, name: str, score: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """``docs``, all columns unchanged, plus the number ``score`` gives for the text."""
    columns = docs.columns

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = score()
        at = columns.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            place = 0
            for _, part in runs([t or "" for t in texts]):
                rows = batch.slice(place, len(part))
                got = pa.array(scorer(texts[place : place + len(part)]), pa.float64())
                place += len(part)
                yield pa.RecordBatch.from_arrays([*rows.columns, got], [*columns, name])

    return bounded_batches(docs).mapInArrow(tasks, StructType(docs.schema.fields + StructType.fromDDL(f"{name} double").fields))
