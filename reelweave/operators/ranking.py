"""Ranking, bands, quotas and set operations on ranked rows.

All cuts are ``row_number() <= k`` so that Spark plans a partial
``WindowGroupLimit`` before the shuffle: a hot query sends at most k rows per
map task, however many candidates it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column]


def ranked(df: DataFrame, by: Sequence[str], order: Order, k: int | None = None, name: str = "rank") -> DataFrame:
    """One-based rank inside ``by``; with ``k`` only the first k rows are kept."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out if k is None else out.filter(F.col(name) <= k)


def best_row(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """First row of each group in ``order`` (one row per map task reaches the shuffle)."""
    return ranked(df, by, order, 1, "_first").drop("_first")


def score_order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("video_id"), F.asc("frame_id")]


def top_k(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    return ranked(df, ["query_id"], score_order(score), k)


def rerank(signals: DataFrame) -> DataFrame:
    """Dense one-based ranks per (query, lane) after filtering a bounded signal list."""
    return ranked(signals.drop("rank"), ["query_id", "lane"], score_order())


def diversify(df: DataFrame, max_per_video: int, k: int, rank: str = "rank") -> DataFrame:
    """At most ``max_per_video`` rows of a video, then the first k of each query."""
    capped = ranked(df, ["query_id", "video_id"], [F.asc(rank)], max_per_video, "_in_video")
    return ranked(capped.withColumnRenamed(rank, "_old"), ["query_id"], [F.asc("_old")], k, rank).drop(
        "_in_video", "_old"
    )


def ordered_union(parts: Sequence[DataFrame], keys: Sequence[str], order: str = "rank", limit: int | None = None) -> DataFrame:
    """Concatenate ranked parts in the given sequence, first occurrence of a key wins.

    ``keys`` includes ``query_id``; the result has ``band`` (which part) and a
    new ``rank``.
    """
    tagged = [p.withColumn("band", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    first = best_row(union, keys, [F.asc("band"), F.asc(order)])
    others = [F.asc(c) for c in keys if c != "query_id"]
    return ranked(
        first.withColumnRenamed(order, "_old"),
        ["query_id"],
        [F.asc("band"), F.asc("_old"), *others],
        limit,
        order,
    ).drop("_old")


def protected_merge(base: DataFrame, rescue: DataFrame, head: int, rescues: int, limit: int | None) -> DataFrame:
    """Base head, then unseen rescue rows, then the rest of the base (each list read once).

    Rescue rows that are already in the base head are dropped before the rescue
    quota applies.
    """
    keys = ["query_id", "video_id", "frame_id"]
    rows = base.select(*keys, "rank", F.lit(0).alias("_src")).unionByName(
        rescue.select(*keys, "rank", F.lit(1).alias("_src"))
    )
    is_head = (F.col("_src") == 0) & (F.col("rank") <= head)
    rows = rows.withColumn("_in_head", F.max(is_head).over(Window.partitionBy(*keys)))
    rows = rows.filter((F.col("_src") == 0) | ~F.col("_in_head"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_src").orderBy("rank")))
    rows = rows.filter((F.col("_src") == 0) | (F.col("_n") <= rescues))
    rows = rows.select(
        *keys,
        F.when(F.col("_src") == 1, 1).when(is_head, 0).otherwise(2).alias("band"),
        F.when(F.col("_src") == 1, F.col("_n")).otherwise(F.col("rank")).alias("_old"),
    )
    first = best_row(rows, keys, [F.asc("band"), F.asc("_old")])
    order = [F.asc("band"), F.asc("_old"), F.asc("video_id"), F.asc("frame_id")]
    return ranked(first, ["query_id"], order, limit).drop("_old")


def unseen(df: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(used.select(*keys).distinct(), list(keys), "left_anti")


def restrict(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def top_up(chosen: DataFrame, pool: DataFrame, limit: int) -> DataFrame:
    """Chosen rows first (in their order), then the best remaining pool rows."""
    keys = ["query_id", "video_id", "frame_id"]
    return ordered_union([chosen, pool], keys, limit=limit)


def group_by_video(results: DataFrame) -> DataFrame:
    """Videos in first-appearance order with hit count and best position."""
    grouped = results.groupBy("query_id", "video_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("best_rank")
    )
    return ranked(grouped, ["query_id"], [F.asc("best_rank"), F.asc("video_id")], name="position")


def specialist_escape(results: DataFrame, specialists: dict[str, tuple[str, int]], limit: int) -> DataFrame:
    """Keep room at the end of a shortlist for strong single-modality rows.

    ``specialists`` maps a modality to (score column, quota). The head keeps
    ``limit - sum(quotas)`` rows; each modality in turn adds its best unseen rows
    with a positive score; free places are filled from the original order. Only rows
    that can get a place reach the windows: the first ``limit`` and, of each modality,
    as many as its own and all earlier quotas together.
    """
    keys = ["query_id", "video_id", "frame_id"]
    reserve = sum(quota for _, quota in specialists.values())
    rest = len(specialists) + 1
    wanted, behind = 0, results.filter(F.col("rank") > max(0, limit - reserve))
    pruned = results.filter(F.col("rank") <= limit)
    for column, quota in specialists.values():
        wanted += quota
        strong = ranked(behind.filter(F.col(column) > 0), ["query_id"], [F.desc(column), F.asc("rank")], wanted, "_n").drop("_n")
        pruned = pruned.unionByName(strong.filter(F.col("rank") > limit))
    rows = pruned.dropDuplicates(keys).withColumn("band", F.when(F.col("rank") <= max(0, limit - reserve), 0).otherwise(rest))
    rows = rows.withColumn("_r", F.col("rank"))
    for band, (column, quota) in enumerate(specialists.values(), start=1):
        free = (F.col("band") == rest) & (F.col(column) > 0)
        w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(free, F.lit(False))), F.desc(column), F.asc("rank"))
        rows = rows.withColumn("_n", F.row_number().over(w))
        picked = F.coalesce(free & (F.col("_n") <= quota), F.lit(False))
        rows = rows.withColumn("_r", F.when(picked, F.col("_n")).otherwise(F.col("_r")))
        rows = rows.withColumn("band", F.when(picked, band).otherwise(F.col("band")))
    rows = rows.select(*keys, "_r", "band")
    return ranked(rows, ["query_id"], [F.asc("band"), F.asc("_r")], limit).drop("_r")


def sanitise_ranking(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Turn a critic's raw answer into a full ranking of the known candidates.

    ``candidates(query_id, candidate_id, position)``; ``answers(query_id,
    position, candidate_id, score)`` is the exploded answer. Unknown ids are
    dropped, the first mention counts, scores are clipped to [0, 1], unmentioned
    candidates follow in their original order, and an answer whose scores are
    all zero is ignored.
    """
    known = answers.join(candidates.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
    first = best_row(
        known.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))))),
        ["query_id", "candidate_id"],
        [F.asc("position")],
    ).select("query_id", "candidate_id", F.col("position").alias("said"), F.col("score").alias("critic_score"))
    usable = first.groupBy("query_id").agg(F.max("critic_score").alias("_top")).filter("_top > 0").select("query_id")
    first = first.join(usable, "query_id", "left_semi")
    joined = candidates.join(first, ["query_id", "candidate_id"], "left")
    return ranked(
        joined,
        ["query_id"],
        [F.asc(F.col("said").isNull().cast("int")), F.asc("said"), F.asc("position")],
    ).select("query_id", "candidate_id", "rank", F.coalesce("critic_score", F.lit(0.0)).alias("critic_score"))


def natural_key(col: Column) -> Column:
    """Digit-aware sort key: text runs lower-cased, digit runs as their length and digits.

    Leading zeros do not count, and digit runs of any length compare as numbers.
    """

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), F.lit(":"), digits)

    parts = F.regexp_extract_all(F.lower(col), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), number(p)).otherwise(p)), ""
    )


def count_by(frames: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables as one table (one aggregate per table)."""
    rows = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("resource"), "n_rows") for name, df in frames.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# The lists of an index answer, in the order in which they are looked for.
INDEX_LISTS = ("ranked_indices", "ranking", "indices", "ranked_candidates", "candidates")


def index_ranking(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Full ranking from a critic's answer that names candidates by zero-based index.

    ``candidates(query_id, candidate_id, position)``; ``answers(query_id, raw)`` is JSON
    with a list of numbers or of objects (``index``, ``candidate_index`` or ``id``). Unknown
    indices are dropped, the first mention counts, unmentioned candidates follow in their
    order. An answer that is no JSON, has an element that is no number or names no candidate
    leaves the original order (``applied`` is false).
    """
    parsed = F.from_json("raw", ", ".join(f"{n} ARRAY<STRING>" for n in INDEX_LISTS))
    first = F.col("_j")[INDEX_LISTS[0]]
    listed = F.when(F.size(first) > 0, first).otherwise(F.coalesce(*[F.col("_j")[n] for n in INDEX_LISTS[1:]]))

    def number(v: Column) -> Column:
        named = F.coalesce(*[F.get_json_object(v, f"$.{n}") for n in ("index", "candidate_index", "id")], F.lit("-1"))
        text = F.when(F.ltrim(v).startswith("{"), named).otherwise(v)
        return F.when(text.rlike(r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$"), text.try_cast("double").cast("bigint"))

    numbers = answers.select("query_id", parsed.alias("_j")).select("query_id", F.transform(listed, number).alias("_v"))
    usable = numbers.filter(F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull()))
    said = usable.select("query_id", F.posexplode("_v").alias("said", "_i"))
    placed = ranked(candidates, ["query_id"], [F.asc("position"), F.asc("candidate_id")], name="_p").withColumn("_i", (F.col("_p") - 1).cast("bigint"))
    known = said.groupBy("query_id", "_i").agg(F.min("said").alias("said"))
    joined = placed.join(known, ["query_id", "_i"], "left")
    applied = F.max(F.col("said").isNotNull()).over(Window.partitionBy("query_id"))
    return ranked(
        joined.withColumn("applied", applied), ["query_id"], [F.asc(F.col("said").isNull()), F.asc("said"), F.asc("_p")]
    ).select("query_id", "candidate_id", "rank", "applied")
