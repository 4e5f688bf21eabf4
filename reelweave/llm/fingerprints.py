"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs: lines, cut again after the ends of
sentences so that one long line is not one unit. Each paragraph is hashed to a wide
vector, and the fingerprint is the sum of the vectors, lane by lane, modulo powers of
two: 64 lanes of random bits modulo 2 ** 14, four lanes of 32 random bits modulo
2 ** 32, and a count modulo 2 ** 32. The sum does not depend on the order, so documents
with the same paragraphs have the same fingerprint, and paragraphs can be added to or
taken from a fingerprint without the text (``insert``, ``delete``).

A paragraph's vector has in its 64 lanes one bit for the paragraph and one for each of
its windows: four words in a row, at its start and after words that end in one of
``BEFORE_WINDOW``. So a paragraph changed in one place keeps most of its windows. Bits of different units are independent. Read as
signs, the lanes of a difference of two fingerprints estimate how many units the
documents do not share, which gives ``likeness``: 1 for equal fingerprints, about the
shared part of all units otherwise. Deviations of lanes are exact while they are below
2 ** 14, which holds for millions of distinct units; a unit that one document has 2 ** 14
times or more can wrap them and spoil the estimate. Equality does not depend on it.

Everything is SQL expressions on the row; sums run over an array of hashes of one text.

Nulls: a null text is the empty text, whose fingerprint is zero; null ids come after all
others, in descending order of a hash of their text. Repeated rows have equal fingerprints. A very
long text is one row with an array of its hashes. An empty table gives no rows. Other
columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Four lanes a word: bits j, j + 16, j + 32 and j + 48 of a hash.
LANE_BIT = 0x0001000100010001
LANE_MOD = 0x3FFF3FFF3FFF3FFF
WORDS = 16
WIDE_MOD = 0xFFFFFFFF
#: Lines, and after the end of a sentence.
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"
#: Letters that end the word before a window: about one word in five of European languages.
BEFORE_WINDOW = "lrt"
#: Four words of one paragraph, seen ahead from where it or the word before it ends.
WINDOW = rf"(?:^|\n|(?<=[.!?{BEFORE_WINDOW}])[ \t]+)(?=((?:[^\n \t]*[^\n \t.!?][ \t]+){{3}}[^\n \t]+))"
#: Bytes of text in one ordered range, and the most ranges whose borders are held at once.
RANGE_BYTES = 16 << 20
RANGES = 1 << 15


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: p != "")


def windows(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WINDOW), F.lit(1))


def with_lanes(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """``rows`` with the summed lanes of a text: an array of WORDS packed words, four wide lanes, the count.

    Paragraphs and hashes are columns of their own: an expression that 20 sums would
    share is evaluated once only if it is one.
    """
    rows = rows.withColumn("_units", paragraphs(text)).withColumn("_windows", windows(text))
    rows = rows.withColumn("_signs", F.concat(F.transform("_units", lambda p: F.xxhash64(p)), F.transform("_windows", lambda w: F.xxhash64(F.lit("window"), w)))).drop("_windows")
    rows = rows.withColumn("_wide", F.transform("_units", lambda p: F.xxhash64(F.lit("wide"), p)))
    rows = rows.withColumn("_more", F.transform("_units", lambda p: F.xxhash64(F.lit("more"), p))).drop("_units")
    return rows.withColumn(out, lanes(F.col("_signs"), F.col("_wide"), F.col("_more"))).drop("_signs", "_wide", "_more")


def lanes(signs: Column, wide: Column, more: Column) -> Column:
    """Lanes from the hashes of a text's paragraphs and windows (signs) and of its paragraphs (wide, more)."""
    zero = F.lit(0).cast("long")

    def packed(j: int) -> Column:
        def bits(h: Column) -> Column:
            return F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANE_BIT))

        few = F.aggregate(signs, zero, lambda a, h: a + bits(h))
        many = F.aggregate(signs, zero, lambda a, h: (a + bits(h)).bitwiseAND(F.lit(LANE_MOD)))
        # below 2 ** 14 units no lane can overflow
        return F.when(F.size(signs) < (1 << 14), few).otherwise(many)

    def added(hashes: Column, shift: int) -> Column:
        return F.aggregate(hashes, zero, lambda a, h: a + F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(WIDE_MOD))).bitwiseAND(F.lit(WIDE_MOD))

    return F.array(*[packed(j) for j in range(WORDS)], *[added(h, s) for h in (wide, more) for s in (0, 32)], F.size(signs).cast("long"))


def lane_mods() -> Column:
    return F.array(*[F.lit(LANE_MOD)] * WORDS, *[F.lit(WIDE_MOD)] * 5)


def insert(fingerprint: Column, change: Column) -> Column:
    """Lanes of a document after paragraphs with lanes ``change`` are added."""
    return F.zip_with(F.zip_with(fingerprint, change, lambda a, b: a + b), lane_mods(), lambda x, m: x.bitwiseAND(m))


def delete(fingerprint: Column, change: Column) -> Column:
    """Lanes of a document after paragraphs with lanes ``change`` are taken away."""
    # a borrowed power of two in every lane keeps lanes from reaching into each other
    over = F.array(*[F.lit(LANE_MOD)] * WORDS, *[F.lit(WIDE_MOD)] * 5)
    ones = F.array(*[F.lit(LANE_BIT)] * WORDS, *[F.lit(1).cast("long")] * 5)
    negated = F.zip_with(F.zip_with(over, change, lambda m, c: m - c), ones, lambda x, one: x + one)
    return insert(fingerprint, F.zip_with(negated, lane_mods(), lambda x, m: x.bitwiseAND(m)))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated shared part of the paragraphs and windows of two documents, 0 to 1."""

    def lane(x: Column, k: int) -> Column:
        return F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0x3FFF))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    n_a, n_b = F.element_at(a, WORDS + 5), F.element_at(b, WORDS + 5)

    def square(x: Column) -> Column:
        return (x * x).cast("double")

    def deviation(x: Column) -> Column:
        # lanes are kept modulo 2 ** 14, so twice a lane is known modulo 2 ** 15
        return F.pmod(x + F.lit(1 << 14), F.lit(1 << 15)) - F.lit(1 << 14)

    def own(v: Column, n: Column) -> Column:
        return total(F.transform(F.slice(v, 1, WORDS), lambda x: reduce(lambda s, t: s + t, [square(deviation(2 * lane(x, k) - n)) for k in range(4)])))

    apart = total(
        F.zip_with(
            F.slice(a, 1, WORDS), F.slice(b, 1, WORDS), lambda x, y: reduce(lambda s, t: s + t, [square(deviation(2 * (lane(x, k) - lane(y, k)) - (n_a - n_b))) for k in range(4)])
        )
    )
    both = own(a, n_a) + own(b, n_b)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - apart / both))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(near)


def fingerprinted(docs: DataFrame, out: str = "lanes") -> DataFrame:
    """``docs`` with the lanes of each text."""
    return with_lanes(docs, F.col("text"), out)


def _borders(rows: DataFrame, value: str, ranges: int) -> list[int]:
    """Approximate quantiles of a column that cut its rows into ``ranges``, descending."""
    if ranges < 2:
        return []
    marks = rows.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).head()[0]
    return sorted(set(marks or []), reverse=True)


def _above(marks: list[int], value: Column) -> Column:
    """How many of the descending ``marks`` are above a value: first by groups, then inside one."""
    if not marks:
        return F.lit(0)
    step = max(1, int(len(marks) ** 0.5))
    full = F.size(F.filter(F.lit(marks[step - 1 :: step]).cast("array<long>"), lambda m: value < m))
    inner = F.slice(F.lit(marks).cast("array<long>"), full * step + 1, F.lit(step))
    return full * step + F.size(F.filter(inner, lambda m: value < m))


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """``doc_id, text, lanes`` with the text and lanes of the next document in descending id.

    Ids are cut into ranges of about ``RANGE_BYTES`` of text (or into ``blocks``) by
    approximate quantiles, null ids likewise by a hash of their text; each range is ordered
    by itself, and sees the first document of the range after it as one more row. So every
    text is shuffled once, and a task holds one range. After the last document comes the
    first. Rows with equal ids (null ids: equal texts) are ordered by their text and share a range.
    """
    rows = docs.select("doc_id", "text").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    numbered = F.col("doc_id").isNotNull()
    size = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)
    held = {r["ok"]: r["size"] for r in rows.groupBy(numbered.alias("ok")).agg(size.alias("size")).collect()}
    ranges = {ok: blocks or max(1, min(RANGES, -(-n // RANGE_BYTES))) for ok, n in held.items()}
    ids = _borders(rows.where(numbered), "doc_id", ranges.get(True, 1))
    nulls = _borders(rows.where(~numbered), "hash", ranges.get(False, 1))
    # range 0 has the highest ids; those of null ids follow
    block = F.when(numbered, _above(ids, F.col("doc_id"))).otherwise(F.lit(len(ids) + 1) + _above(nulls, F.col("hash")))
    rows = rows.withColumn("block", block.cast("int")).withColumn("hash", F.when(~numbered, F.col("hash")))
    # at most RANGES rows each of ids and of null ids: where the order of a range starts
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top"), F.max("hash").alias("top_hash")).orderBy("block").collect()
    heads = [(t["top"], t["top_hash"], tops[i - 1]["block"] if i else tops[-1]["block"], 1 if i else 2) for i, t in enumerate(tops)]
    if heads:
        heads = docs.sparkSession.createDataFrame(heads, "top bigint, top_hash bigint, into int, ghost int")
        first = F.col("doc_id").eqNullSafe(F.col("top")) & F.col("hash").eqNullSafe(F.col("top_hash"))
        ghosts = rows.join(F.broadcast(heads), first).select("doc_id", "text", "hash", F.col("into").alias("block"), "ghost").dropDuplicates()
        rows = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    else:
        rows = rows.withColumn("ghost", F.lit(0))
    order = Window.partitionBy("block").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.desc("hash"), F.coalesce("text", F.lit("")))
    rows = fingerprinted(rows)
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_lanes", F.lead("lanes").over(order))
    return rows.where("ghost = 0").drop("block", "ghost", "hash")


def edited(docs: DataFrame, *, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they seem.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first
    as many (or all) of the next document's.
    """
    rows = with_next(docs, blocks)
    text, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited_text", F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))).drop("next_text")
    rows = with_lanes(rows, F.col("edited_text"), "edited_lanes")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
