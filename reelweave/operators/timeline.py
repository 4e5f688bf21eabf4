"""Kernels over ordered time axes: as-of lookups, neighbour sums, gaps, greedy windows.

Every kernel cuts the axis of a video into chunks and works per (keys, chunk),
so one video holding a large share of the rows is spread over many tasks. What
has to cross a chunk border is copied there (a halo as wide as the tolerance) or
carried over from a per-chunk summary, which is far smaller than the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_of(pos: Column, width: int | float) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def with_halo(df: DataFrame, pos: str, reach: int | float, chunk: int | float) -> DataFrame:
    """Copy each row to every chunk within ``reach`` of it; ``_own`` marks its home."""
    lo = chunk_of(F.col(pos) - F.lit(reach), chunk)
    hi = chunk_of(F.col(pos) + F.lit(reach), chunk)
    return df.withColumn("_c", F.explode(F.sequence(lo, hi))).withColumn(
        "_own", F.col("_c") == chunk_of(F.col(pos), chunk)
    )


def _carried(right: DataFrame, left: DataFrame, on: Sequence[str], lpos: str, chunk: int | float) -> DataFrame:
    """Nearest right row before and after each chunk that has left rows."""
    per_chunk = right.groupBy(*on, "_c").agg(F.min("_hit").alias("_first"), F.max("_hit").alias("_last"))
    needed = left.select(*on, chunk_of(F.col(lpos), chunk).alias("_c")).distinct()
    grid = per_chunk.unionByName(needed, allowMissingColumns=True).groupBy(*on, "_c").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    before = Window.partitionBy(*on).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*on).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    edges = grid.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).withColumn(
        "_after", F.last("_first", ignorenulls=True).over(after)
    )
    return edges.select(*on, "_c", F.explode(F.array("_before", "_after")).alias("_hit")).filter(F.col("_hit").isNotNull())


def asof(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_pos: str,
    right_pos: str,
    take: Sequence[str],
    direction: str = "nearest",
    tolerance: int | float | None = None,
    strict: bool = False,
    chunk: int | float = CHUNK,
) -> DataFrame:
    """Attach the nearest right row of the same keys to each left row.

    ``direction`` is backward (at or before), forward (at or after) or nearest;
    an equal distance goes to the earlier row. Adds ``matched_pos`` and the
    ``take`` columns, null when nothing lies within the tolerance (``strict``:
    nearer than it). Right positions must be unique per key.
    """
    hit = F.struct(F.col(right_pos).alias("pos"), *[F.col(c).alias(c) for c in take])
    rows = right.select(*on, F.col(right_pos).alias("_p"), hit.alias("_hit"))
    if tolerance is None:
        rows = rows.withColumn("_c", chunk_of(F.col("_p"), chunk))
        extra = _carried(rows, left, on, left_pos, chunk)
        rows = rows.select(*on, "_c", "_hit").unionByName(extra.select(*on, "_c", "_hit"))
    else:
        rows = with_halo(rows, "_p", tolerance, max(chunk, tolerance)).select(*on, "_c", "_hit")
        chunk = max(chunk, tolerance)
    probes = left.select(
        *on,
        chunk_of(F.col(left_pos), chunk).alias("_c"),
        F.col(left_pos).alias("_x"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    both = probes.withColumn("_side", F.lit(1)).unionByName(
        rows.withColumn("_x", F.col("_hit.pos")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    part = Window.partitionBy(*on, "_c")
    run = (Window.unboundedPreceding, Window.currentRow)
    back = F.last("_hit", ignorenulls=True).over(part.orderBy("_x", "_side").rowsBetween(*run))
    ahead = F.last("_hit", ignorenulls=True).over(part.orderBy(F.desc("_x"), "_side").rowsBetween(*run))
    if direction == "backward":
        found = both.withColumn("_m", back)
    elif direction == "forward":
        found = both.withColumn("_m", ahead)
    else:
        found = both.withColumn("_b", back).withColumn("_f", ahead)
        nearer = F.col("_b").isNull() | ((F.col("_f.pos") - F.col("_x")) < (F.col("_x") - F.col("_b.pos")))
        found = found.withColumn("_m", F.when(nearer, F.col("_f")).otherwise(F.col("_b")))
    found = found.filter("_side = 1")
    if tolerance is not None:
        distance = F.abs(F.col("_m.pos") - F.col("_x"))
        near = distance < tolerance if strict else distance <= tolerance
        found = found.withColumn("_m", F.when(near, F.col("_m")))
    return found.select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns],
        F.col("_m.pos").alias("matched_pos"),
        *[F.col(f"_m.{c}").alias(c) for c in take],
    )


def neighbour_totals(df: DataFrame, keys: Sequence[str], pos: str, score: str, reach: int | float, chunk: int | float = CHUNK) -> DataFrame:
    """Sum and count of scores within ``reach`` of each position, itself included.

    Rows at one position are added up first, so a crowded moment is one row;
    the result has one row per position: ``sum_near``, ``n_near``.
    """
    points = df.groupBy(*keys, pos).agg(F.sum(score).alias("_s"), F.count(F.lit(1)).alias("_n"))
    haloed = with_halo(points, pos, reach, max(chunk, reach))
    bound = f"{reach}D" if isinstance(reach, float) else str(reach)
    over = (
        f"OVER (PARTITION BY {', '.join(keys)}, _c ORDER BY {pos} "
        f"RANGE BETWEEN {bound} PRECEDING AND {bound} FOLLOWING)"
    )
    return (
        haloed.withColumn("sum_near", F.expr(f"sum(_s) {over}"))
        .withColumn("n_near", F.expr(f"sum(_n) {over}"))
        .filter("_own")
        .select(*keys, pos, "sum_near", "n_near")
    )


def positions(df: DataFrame, keys: Sequence[str], pos: str, ties: Sequence[str] = (), name: str = "position", chunk: int | float = CHUNK, parts: int | None = None) -> DataFrame:
    """One-based position of each row in its group: rank inside the chunk plus the
    number of rows in earlier chunks. ``parts`` tasks order the chunks, if given."""
    rows = df.withColumn("_c", chunk_of(F.col(pos), chunk))
    counts = rows.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_c").orderBy(pos, *ties)
    if parts is not None:
        rows = rows.repartition(parts, *keys, "_c")
    return (
        rows.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*keys, "_c"])
        .withColumn(name, F.col("_r") + F.col("_before"))
        .drop("_r", "_before", "_c")
    )


def gap_islands(df: DataFrame, keys: Sequence[str], pos: str, gap: int, name: str = "island", chunk: int = CHUNK) -> DataFrame:
    """Label runs of positions whose steps are at most ``gap`` by their first position."""
    points = df.select(*keys, pos).distinct()
    near = with_halo(points, pos, gap, max(chunk, gap))
    w = Window.partitionBy(*keys, "_c").orderBy(pos)
    starts = (
        near.withColumn("_prev", F.lag(pos).over(w))
        .filter(F.col("_own") & (F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > gap)))
        .select(*keys, F.col(pos).alias("_start"))
    )
    return asof(df, starts, keys, pos, "_start", [], "backward", chunk=chunk).withColumnRenamed("matched_pos", name)


def greedy_anchors(df: DataFrame, keys: Sequence[str], pos: str, width: int, name: str = "anchor", span: int = 64) -> DataFrame:
    """Greedy windows: a position more than ``width`` after the window's first
    position opens a new window; each row gets its window's first position.

    The chain of anchors is sequential, so each chunk first computes where it
    would end for every way it can be entered (at most width + 2 entries), one
    fold per video over those summaries finds the real entry of each chunk, and
    the chunks then list their anchors independently.
    """
    size = span * (width + 1)
    points = df.select(*keys, F.col(pos).cast("bigint").alias("_p")).distinct()
    chunks = (
        points.withColumn("_c", chunk_of(F.col("_p"), size))
        .groupBy(*keys, "_c")
        .agg(F.sort_array(F.collect_set("_p")).alias("_ps"))
    )
    w = F.lit(width).cast("bigint")
    border = F.col("_c") * F.lit(size) + w
    entries = F.concat(
        F.filter("_ps", lambda p: p <= border), F.slice(F.filter("_ps", lambda p: p > border), 1, 1)
    )
    summary = chunks.select(
        *keys,
        "_c",
        F.transform(
            entries,
            lambda e: F.struct(
                e.alias("first"),
                F.aggregate(F.col("_ps"), e, lambda a, p: F.when(p - a > w, p).otherwise(a)).alias("last"),
            ),
        ).alias("_moves"),
    )
    none = F.lit(None).cast("bigint")
    path = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_c", "_moves"))).alias("_all"))

    def step(state: Column, item: Column) -> Column:
        usable = F.filter(item["_moves"], lambda m: state["open"].isNull() | (m["first"] - state["open"] > w))
        nxt = F.when(F.size(usable) > 0, F.element_at(usable, 1)["last"]).otherwise(state["open"])
        return F.struct(
            nxt.alias("open"),
            F.concat(state["seen"], F.array(F.struct(item["_c"].alias("_c"), state["open"].alias("_open")))).alias("seen"),
        )

    start = F.struct(
        none.alias("open"),
        F.array().cast("array<struct<_c:bigint,_open:bigint>>").alias("seen"),
    )
    opened = path.select(*keys, F.explode(F.aggregate("_all", start, step)["seen"]).alias("_e")).select(
        *keys, "_e._c", "_e._open"
    )

    def extend(acc: Column, p: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1)["anchor"]).otherwise(F.col("_open"))
        fresh = last.isNull() | (p - last > w)
        return F.concat(acc, F.array(F.struct(p.alias("pos"), F.when(fresh, p).otherwise(last).alias("anchor"))))

    seed = F.array().cast("array<struct<pos:bigint,anchor:bigint>>")
    placed = (
        chunks.join(opened, [*keys, "_c"])
        .select(*keys, F.explode(F.aggregate("_ps", seed, extend)).alias("_a"))
        .select(*keys, F.col("_a.pos").alias("_p"), F.col("_a.anchor").alias(name))
    )
    return df.withColumn("_p", F.col(pos).cast("bigint")).join(placed, [*keys, "_p"], "left").select(*df.columns, name)


def greedy_spaced(df: DataFrame, keys: Sequence[str], pos: str, order: Sequence[Column], gap: int | float, limit: int, fill: bool = False) -> DataFrame:
    """Pick up to ``limit`` rows per group in ascending ``order``, each at least ``gap``
    from all earlier picks; with ``fill`` free places go to the best skipped rows.

    Adds ``pick`` (1-based). Positions must be unique per group. A pick can only
    touch its own gap-wide cell and the two next to it, so the picks all lie in
    the 3 * limit - 2 cells with the best rows, and the first 2 * limit rows, which
    are all that ``fill`` can need, in as many cells: only the rows of those are gathered.
    """
    from reelweave.operators.ranking import ranked

    kept = [c for c in df.columns if c not in keys]
    rows = df.select(
        *keys,
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(pos).alias("pos"), F.struct(*kept).alias("row")).alias("_x"),
        F.floor(F.col(pos) / F.lit(gap)).alias("_b"),
    )
    if not fill:
        rows = rows.dropna(subset=[*keys, "_b"])
    cells = rows.groupBy(*keys, "_b").agg(F.sort_array(F.collect_set("_x")).alias("_cell"))
    wanted = max(3 * limit - 2, 2 * limit) if fill else 3 * limit - 2
    top = ranked(cells, keys, [F.asc(F.col("_cell")[0])], wanted, "_n")
    packed = top.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("_cell"))).alias("_xs"))
    kind = packed.schema["_xs"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        free = (F.size(acc) < limit) & F.forall(acc, lambda a: F.abs(a["pos"] - x["pos"]) >= gap)
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    alone = F.size("_xs") == 1
    picks = packed.withColumn("_picked", F.when(alone, F.col("_xs")).otherwise(F.aggregate("_xs", F.array().cast(kind), step)))
    chosen = F.col("_picked")
    if fill:
        rest = F.filter("_xs", lambda x: ~F.exists("_picked", lambda p: p["pos"] == x["pos"]))
        chosen = F.when(alone, chosen).otherwise(F.slice(F.concat(chosen, rest), 1, limit))
    told = [F.col(c) if c in keys else F.col(f"_p.row.{c}").alias(c) for c in df.columns]
    return picks.select(*keys, F.posexplode(chosen).alias("_i", "_p")).select(*told, (F.col("_i") + 1).alias("pick"))


def nearest_k(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: Sequence[str], left_pos: str, right_pos: str, k: int, chunk: int | float = CHUNK) -> DataFrame:
    """The k right positions closest to each left row, earlier ones first on ties.

    The as-of match gives the place of a row among the right positions; its k
    neighbours on either side are then looked up by position number.
    """
    from reelweave.operators.ranking import ranked

    numbered = positions(right.select(*on, F.col(right_pos).alias("_rp")).distinct(), on, "_rp", name="_i", chunk=chunk)
    at = asof(left, numbered, on, left_pos, "_rp", ["_i"], "backward", chunk=chunk).drop("matched_pos")
    base = F.coalesce("_i", F.lit(0))
    wanted = at.withColumn("_i", F.explode(F.sequence(base - (k - 1), base + k)))
    found = wanted.join(numbered, [*on, "_i"]).withColumn("distance", F.abs(F.col("_rp") - F.col(left_pos)))
    return ranked(found, [*on, *left_id], [F.asc("distance"), F.asc("_rp")], k).select(
        *left.columns, F.col("_rp").alias(right_pos), "distance", "rank"
    )


def nearest_interval(left: DataFrame, right: DataFrame, on: Sequence[str], left_pos: str, start: str, end: str, take: Sequence[str], limit: float | None = None, chunk: int | float = CHUNK) -> DataFrame:
    """Nearest interval of the same keys by distance to [start, end] (0 inside).

    Of the intervals that begin at or before the row the one reaching furthest is
    compared with the next one to begin; ``limit`` keeps distances below it.
    """
    fields = [F.col(c).alias(c) for c in take]
    rows = right.select(
        *on,
        F.col(start).cast("double").alias("_x"),
        F.struct(F.col(end).cast("double").alias("e"), F.col(start).cast("double").alias("s"), *fields).alias("_by_end"),
        F.struct(F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"), *fields).alias("_by_start"),
    ).withColumn("_c", chunk_of(F.col("_x"), chunk))
    per_chunk = rows.groupBy(*on, "_c").agg(F.max("_by_end").alias("_far"), F.min("_by_start").alias("_next"))
    needed = left.select(*on, chunk_of(F.col(left_pos), chunk).alias("_c")).distinct()
    grid = per_chunk.unionByName(needed, allowMissingColumns=True).groupBy(*on, "_c").agg(
        F.max("_far").alias("_far"), F.min("_next").alias("_next")
    )
    prev = Window.partitionBy(*on).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*on).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select(
        *on, "_c", F.max("_far").over(prev).alias("_cf"), F.min("_next").over(later).alias("_cn")
    )
    probes = left.select(
        *on,
        chunk_of(F.col(left_pos), chunk).alias("_c"),
        F.col(left_pos).cast("double").alias("_x"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    ).withColumn("_side", F.lit(1))
    both = probes.unionByName(rows.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    part = Window.partitionBy(*on, "_c")
    run = (Window.unboundedPreceding, Window.currentRow)
    local = (
        both.withColumn("_f", F.max("_by_end").over(part.orderBy("_x", "_side").rowsBetween(*run)))
        .withColumn("_n", F.min("_by_start").over(part.orderBy(F.desc("_x"), F.desc("_side")).rowsBetween(*run)))
        .filter("_side = 1")
        .join(carried, [*on, "_c"], "left")
    )
    far = F.greatest("_f", "_cf")
    nxt = F.coalesce("_n", "_cn")
    gap_back = F.greatest(F.lit(0.0), F.col("_x") - far["e"])
    gap_next = nxt["s"] - F.col("_x")
    use_next = far.isNull() | (gap_next < gap_back)
    out = local.select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns],
        F.when(use_next, nxt["s"]).otherwise(far["s"]).alias("matched_start"),
        F.when(use_next, gap_next).otherwise(gap_back).alias("distance"),
        *[F.when(use_next, nxt[c]).otherwise(far[c]).alias(c) for c in take],
    )
    if limit is None:
        return out
    near = F.col("distance") < limit
    return out.select(
        *left.columns, *[F.when(near, F.col(c)).alias(c) for c in ["matched_start", "distance", *take]]
    )
