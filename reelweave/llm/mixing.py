"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Whole copies are certain: each document of a
source is taken ``floor(target / source size)`` times. What remains of the target is
drawn without replacement: a document with inclusion probability ``p`` and a uniform
number ``u`` that only its id decides has the Pareto rank
``(u / (1 - u)) / (p / (1 - p))``, and documents are taken in the order of their ranks
until the words that remain are used up. Shorter documents have the better odds
(``p`` is proportional to ``importance``), so the sample is one of unequal
probabilities and of fixed size, counted in words.

The rank order is never a sort of a whole source: ranks fall into ``BUCKETS`` equal
classes of ``rank / (1 + rank)``, sums of the classes give the class in which the
target is reached, and only that class is ordered. A document that no longer fits is
passed over; further rounds fill the gap with later documents that do fit, and one closing
document, the one whose size comes closest to what is still missing, ends the draw.

Nulls: a null text has size 0; null sources form one source, ordered last; a null id
draws the number of the word "null". Rows that repeat an id share its number. An empty
table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm.common import cut_lineage, source_key, word_count

BUCKETS = 4096
ROUNDS = 3
#: Sources in code point order weigh 1, 2, 3, 1, 2, 3, ...
CYCLE = 3
#: No document is taken more often than this.
MAX_COPIES = 3


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that only the id and the seed decide."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long") + 0.5) / float(2**48)


def importance(size: Column) -> Column:
    """Relative odds in thousandths: 1000 for short documents, down to 500 for long ones."""
    return F.floor(1000.0 - 500.0 * size / (size + 2000.0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """Targets of the sources ``(key, source, source_size, odds)``: one row per source.

    Weights share ``share`` of all words; a source stops at MAX_COPIES times its size and
    its excess is dealt anew by weight (water filling, solved by one ordered pass).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy("fill", "key")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(CYCLE)) + 1).cast("long"))
    s = s.withColumn("fill", F.col("source_size").cast("double") / F.col("weight"))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - MAX_COPIES * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    full = F.col("level") * F.col("weight") > MAX_COPIES * F.col("source_size")
    s = s.withColumn("full", full).withColumn("open_level", F.min(F.when(~full, F.struct("fill", "key", "level"))).over(whole)["level"])
    return s.select("key", "source", "source_size", "odds", "weight", F.when(F.col("full"), MAX_COPIES * F.col("source_size").cast("double")).otherwise(F.col("open_level") * F.col("weight")).alias("target"))


def with_ranks(rows: DataFrame, seed: str) -> DataFrame:
    """Adds the rank (null where a document cannot be drawn) and its class."""
    p = F.when(F.col("odds") > 0, F.col("rest") * F.col("imp") / F.col("odds"))
    u = uniform(F.col("doc_id"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("p", p).withColumn("q", F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, q))
    rows = rows.withColumn("t", F.col("q") / (1 + F.col("q")))
    return rows.withColumn("bucket", F.least(F.floor(F.col("t") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def _taken_in(r: int) -> Column:
    """Whether the finished round ``r`` took the row."""
    here = _name()
    inside = (F.col(f"edge_{r}").isNull()) | (F.col("bucket") < F.col(f"edge_{r}")) | ((F.col("bucket") == F.col(f"edge_{r}")) & F.coalesce(here <= F.col(f"cut_{r}"), F.lit(False)))
    return F.coalesce(F.col("t").isNotNull() & (F.col("size") <= F.col(f"gap_{r}")) & inside, F.lit(False))


def drawn(rounds: int = ROUNDS) -> Column:
    out = F.lit(False)
    for r in range(1, rounds + 1):
        out = out | _taken_in(r)
    return out


def _name() -> Column:
    return F.struct("t", F.coalesce("doc_id", F.lit(-1)).alias("id"), "size")


def closing() -> Column:
    """Whether the row is its source's closing document."""
    return F.coalesce(_name() == F.col("closing"), F.lit(False))


def plan(narrow: DataFrame, *, share: float = 1.0, seed: str = "mix", rounds: int = ROUNDS) -> DataFrame:
    """One row per source: target, whole copies, and where each round of the draw stopped.

    ``narrow`` has ``key, source, doc_id, size`` and is read several times, so it should
    be a stored table.
    """
    sizes = narrow.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * importance(F.col("size"))).alias("odds"))
    state = targets(sizes, share).withColumn("copies", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("int"))
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("gap_1", F.col("rest"))
    state = cut_lineage(state.drop("source"))
    # ranks are found once; the rounds read them stored
    ranked = with_ranks(narrow.withColumn("imp", importance(F.col("size"))).join(state, "key"), seed).where(F.col("t").isNotNull())
    ranked = cut_lineage(ranked.select("key", "doc_id", "size", "t", "bucket"))
    for r in range(1, rounds + 1):
        left = (F.col("size") <= F.col(f"gap_{r}")) & ~drawn(r - 1)
        classes = ranked.join(state, "key").where(left).groupBy("key", "bucket", F.col(f"gap_{r}").alias("gap")).agg(F.sum("size").alias("words"))
        classes = classes.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")))
        edge = classes.groupBy("key").agg(
            F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("edge"),
            F.max("upto").alias("all_words"),
        )
        edge = edge.select("key", F.col("edge.bucket").alias(f"edge_{r}"), F.coalesce("edge.before", "all_words").alias("before"))
        state = cut_lineage(state.join(edge, "key", "left"))
        inside = ranked.join(state, "key").where(left & (F.col("bucket") == F.col(f"edge_{r}")))
        inside = inside.select("key", "size", "t", "before", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col(f"gap_{r}").alias("gap"))
        inside = inside.withColumn("words", F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("t", "id", "size")))
        cut = inside.where("words <= gap").groupBy("key").agg(F.max(F.struct("t", "id", "size")).alias(f"cut_{r}"), F.max("words").alias("reached"))
        got = F.coalesce("reached", "before", F.lit(0))
        state = cut_lineage(state.join(cut, "key", "left").withColumn(f"gap_{r + 1}", F.col(f"gap_{r}") - got).drop("reached", "before"))
    gap = F.col(f"gap_{rounds + 1}")
    off = F.abs(F.col("size") - gap)
    last = ranked.join(state, "key").where(~drawn(rounds) & (off < gap))
    last = last.groupBy("key").agg(F.min(F.struct(off.alias("off"), _name().alias("name"))).alias("last"))
    return cut_lineage(state.join(last.select("key", F.col("last.name").alias("closing")), "key", "left"))


def narrow_of(docs: DataFrame) -> DataFrame:
    """What the plan needs of a document, stored once: texts are read a single time for it."""
    out = docs.select(source_key(F.col("source")).alias("key"), "source", "doc_id", word_count(F.col("text")).alias("size"))
    return cut_lineage(out)


def allocation(rows: DataFrame, state: DataFrame, *, seed: str = "mix", rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (with ``key, doc_id, size``) with ``source_size, target`` and ``n_copies``."""
    out = with_ranks(rows.withColumn("imp", importance(F.col("size"))).join(state, "key"), seed)
    return out.withColumn("n_copies", F.col("copies") + (drawn(rounds) | closing()).cast("int"))


def mix_table(docs: DataFrame, *, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """One row per document: its size, its source's size and target, copies and words taken."""
    narrow = narrow_of(docs)
    out = allocation(narrow, plan(narrow, share=share, seed=seed), seed=seed)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("n_copies").alias("copies"), (F.col("n_copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken; same columns."""
    state = plan(narrow_of(docs), share=share, seed=seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), source_key(F.col("source")).alias("key"), "doc_id", word_count(F.col("text")).alias("size"))
    rows = allocation(rows, state, seed=seed).where("n_copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("doc.*")


def oracle(share: float = 1.0, seed: str = "mix", rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the rows of the mix, with plain windows over whole sources."""
    ctes = [
        """sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents)""",
        """weighed AS (SELECT *, CAST(floor(1000.0 - 500.0 * size / (size + 2000.0)) AS BIGINT) AS imp FROM sized)""",
        """sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * imp) AS BIGINT) AS odds FROM weighed GROUP BY source)""",
        f"""ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1 AS weight FROM sources)""",
        """filled AS (SELECT *, source_size::DOUBLE / weight AS fill, coalesce('=' || source, '-') AS key FROM ranked)""",
        f"""levels AS (SELECT *, ((sum(source_size) OVER ())::BIGINT * {float(share)}::DOUBLE - {MAX_COPIES} * coalesce(sum(source_size) OVER b, 0)::BIGINT)
            / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT)::DOUBLE AS level
            FROM filled WINDOW b AS (ORDER BY fill, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        f"""aimed AS (SELECT *, CASE WHEN level * weight > {MAX_COPIES} * source_size THEN {MAX_COPIES}::DOUBLE * source_size
            ELSE (SELECT level FROM levels WHERE NOT level * weight > {MAX_COPIES} * source_size ORDER BY fill, key LIMIT 1) * weight END AS target FROM levels)""",
        """copied AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS copies FROM aimed)""",
        """rest AS (SELECT *, target - copies * source_size AS rest FROM copied)""",
        f"""odds AS (SELECT w.*, r.source_size, r.target, r.copies, r.rest, CASE WHEN r.odds > 0 THEN r.rest * w.imp / r.odds END AS p,
            (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 12))::BIGINT + 0.5::DOUBLE) / {2**48}::DOUBLE AS u
            FROM weighed w JOIN rest r ON w.source IS NOT DISTINCT FROM r.source)""",
        """drawing AS (SELECT *, CASE WHEN p >= 1 THEN 0::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM odds)""",
        """round_0 AS (SELECT *, q / (1 + q) AS t, rest AS gap, FALSE AS got FROM drawing)""",
    ]
    for r in range(1, rounds + 1):
        ctes.append(
            f"""summed_{r} AS (SELECT *, CASE WHEN NOT got AND t IS NOT NULL AND size <= gap THEN sum(CASE WHEN NOT got AND t IS NOT NULL AND size <= gap THEN size ELSE 0 END)
            OVER (PARTITION BY source ORDER BY t NULLS LAST, coalesce(doc_id, -1), size) END AS upto FROM round_{r - 1})"""
        )
        ctes.append(f"""fits_{r} AS (SELECT * REPLACE (got OR coalesce(upto <= gap, FALSE) AS got), coalesce(upto <= gap, FALSE) AS now FROM summed_{r})""")
        ctes.append(f"""round_{r} AS (SELECT * EXCLUDE (upto, now) REPLACE (gap - coalesce(sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source), 0) AS gap) FROM fits_{r})""")
    ctes.append(f"""ended AS (SELECT *, CASE WHEN NOT got AND t IS NOT NULL AND abs(size - gap) < gap THEN
        rank() OVER (PARTITION BY source ORDER BY NOT got AND t IS NOT NULL AND abs(size - gap) < gap DESC, abs(size - gap), t, coalesce(doc_id, -1)) END AS place FROM round_{rounds})""")
    ctes.append("""closed AS (SELECT * REPLACE (got OR coalesce(place = 1, FALSE) AS got) FROM ended)""")
    final = "closed"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, source, size::BIGINT AS size, source_size, target, (copies + got::INT)::INTEGER AS copies, ((copies + got::INT) * size)::BIGINT AS taken FROM {final}"
