"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelweave.session import cut_lineage

__all__ = ["BATCH_ROWS", "WORD", "bounded_batches", "connected_components", "cut_lineage", "held_out", "labelled_sample", "least_hashes", "read_table", "small_table", "source_key", "word_count"]

#: Rows of texts that Python gets at once.
BATCH_ROWS = 1024
#: A word is a run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a table made by SQL alone: one literal, no Python worker."""
    names = [c.split()[0] for c in schema.split(", ")]
    held = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(held), "array<struct<" + ", ".join(c.replace(" ", ":") for c in schema.split(", ")) + ">>")))


def bounded_batches(rows: DataFrame) -> DataFrame:
    """``rows``, whose session hands Python at most BATCH_ROWS rows at a time from now on.

    Texts are long: the default of 10,000 rows a batch is held several times over, by the
    executor and by its Python workers.
    """
    conf = rows.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One label per document that models may learn from: ``doc_id, label``."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def least_hashes(ids: DataFrame, per_label: int) -> DataFrame:
    """``doc_id, label, place`` of the ``per_label`` rows of ``ids`` with the least hashes, per label.

    Rows are counted per label first and only hashes below a cutoff that leaves about twice
    the rows wanted are ranked, so what a label's task sorts does not grow with the table.
    """
    ids = cut_lineage(ids.select("doc_id", "label").withColumn("h", F.xxhash64("doc_id")))
    n = ids.groupBy("label").agg(F.count("*").alias("n"))  # a row per label, as every model here has
    near = (F.col("h").cast("double") + 2.0**63) / 2.0**64 <= F.lit(2.0 * per_label + 200) / F.col("n")
    few = ids.join(F.broadcast(n), "label").where(near)
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    return few.withColumn("place", place).where(F.col("place") <= per_label).select("doc_id", "label", "place")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """``doc_id, label, text`` of at most ``per_class`` documents of each label value.

    The documents with the least hashes of their ids. Which ones, is found from the ids
    alone and stored; texts are then read once.
    """
    rows = labels_of(labels, column).join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = cut_lineage(least_hashes(rows, per_class).select("doc_id", "label"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id")
    # of rows that repeat an id, the least text
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def source_key(source: Column) -> Column:
    """A join key that is never null; the null source has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for undirected ``edges (a, b)``; root is the least node of the component.

    Alternates the large-star and small-star steps, so the number of rounds is
    logarithmic in the longest chain. Each round is aggregated before it is joined
    back, is written to the shared folder, and ends when no edge has changed. Hubs
    are join keys of plain equi-joins, which AQE splits when skewed.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    while True:
        pairs = cut_lineage(pairs)
        print_of = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).head()
        if tuple(print_of) == seen:
            break
        seen = tuple(print_of)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v")
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
