"""Sharding by a k-d tree over document metadata.

All documents start in one node of ``k`` shards. A node is cut along its widest metadata
dimension near the weighted quantile that leaves ``floor(k / 2)`` shares of its bytes below, and
its shards are dealt to the two parts in proportion to their bytes; this repeats until
every leaf is one shard of the target bytes (total / shards).

Coordinates are functions of the text alone: its size, bytes per character, length of its
lines and, as the last, a hash. A row's place along a dimension is the coordinate with another hash of
the text behind it, so equal texts lie at one point and stay together: a cut goes beside a
point, and only a text whose copies are heavier than a whole shard is cut, by a hash of the row. Where a
heavy point makes the parts uneven, the next widest dimension is tried, and the evenest cut taken.

The quantile is found by counting: bytes per class of the node's range, ``BINS`` classes a
pass, then per class of the class that holds it, until that is one point or light enough to be
left whole. A pass handles all nodes of a level at once and returns one row per node, so
the driver holds the tree of a level and no more; its nodes and cuts, fewer than there are
shards, meet the rows as a small table. The node of a row is a stored column: each level writes the narrow table anew, with the
nodes its cuts lead to, and deletes the one before. No expression grows with the tree.

Slots count from 0 within a shard without a gap: rows are numbered within (shard,
block), a block being a class of the row's hash, after the rows of earlier blocks.

Nulls: a null text has no bytes and size 16; null ids are ids like others. Texts of any length
are one point each. Repeated rows are rows: each gets a slot. Ties (one point) stay together as said. A table without rows gives none. Other columns
do not matter. One shard takes everything. Shards stay empty only where there are fewer rows than
shards, or where a few texts that may not be cut hold more than their shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm.common import cut_lineage, small_table
from reelweave.session import Stages

BINS = 1 << 14
#: Bits of a coordinate, of the text's hash behind it, and of the row's hash.
DIM_BITS, TEXT_BITS, ROW_BITS = 27, 35, 62
#: A class of at most this share of the target bytes is left whole.
LIGHT = 0.005
#: Another dimension is tried where a part is off by more than this share of the target.
UNEVEN = 0.02
BLOCKS = 256
OVERHEAD = 16


@dataclass
class Node:
    """Shards ``first .. first + k - 1``, with the rows and bytes they are to take."""

    first: int
    k: int
    rows: int
    bytes: int
    #: Dimensions from the widest to the narrowest, with their first and last value.
    dims: list[tuple[int, int, int]]


@dataclass
class Cut:
    """Rows of ``node`` below (point, row hash) along ``dim`` go to its first ``left`` shards."""

    node: int
    dim: int
    point: int
    row: int
    left: int
    off: float


@dataclass
class Found:
    """A class of a range: its first value and width, and rows and bytes below it and in it."""

    low: int
    width: int
    rows_below: int = 0
    below: int = 0
    rows: int = 0
    bytes: int = 0
    splits: bool = False


def dimensions(text: Column) -> list[Column]:
    """The metadata of a text as whole numbers below 2 ** DIM_BITS."""
    top = (1 << DIM_BITS) - 1
    chars = F.greatest(F.char_length(text), F.lit(1))
    size = F.octet_length(text)
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    # natural logarithms of sizes stay below 22; a character has at most 4 bytes
    raw = [F.log1p(size.cast("double")) / 22.0, (size / chars - 1.0) / 3.0, F.log1p(chars / lines) / 22.0]
    scaled = [F.least(F.greatest(F.floor(x * top), F.lit(0)), F.lit(top)).cast("long") for x in raw]
    return [*scaled, F.shiftrightunsigned(F.xxhash64(F.lit("place"), text), 64 - DIM_BITS)]


def narrow_of(docs: DataFrame) -> DataFrame:
    """Id, size, checksum, coordinates, hashes of text and row, and the node: 0 for all."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS).alias("text_hash"),
        F.lit(False).alias("splits"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.monotonically_increasing_id()), 64 - ROW_BITS).alias("row_hash"),
        F.lit(0).alias("node"),
        *[d.alias(f"d{i}") for i, d in enumerate(dimensions(text))],
    )


def _point(dims: int) -> Column:
    """The place of a row along the dimension named by ``dim``."""
    coordinate = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"d{i}")) for i in range(dims)])
    return F.shiftleft(coordinate, TEXT_BITS) + F.col("text_hash")


def _quantiles(rows: DataFrame, ranges: dict[int, Found], goals: dict[int, float], light: float) -> dict[int, Found]:
    """Per node the class of ``key`` in which the bytes reach the goal; ``rows`` has ``node, key, size``."""
    spark, found = rows.sparkSession, dict(ranges)
    while active := [n for n, f in found.items() if f.width > 1 and (f.rows == 0 or f.bytes > light)]:
        asks = [(n, found[n].low, found[n].width, -(-found[n].width // BINS), float(goals[n] - found[n].below)) for n in active]
        small = F.broadcast(small_table(spark, asks, "node int, low long, width long, step long, goal double"))  # a row per node
        inside = rows.join(small, "node").withColumn("offset", F.col("key") - F.col("low")).where("offset >= 0 AND offset < width")
        bins = inside.groupBy("node", F.expr("offset div step").alias("bin")).agg(
            F.first("goal").alias("goal"), F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"), F.max("splits").alias("splits")
        )
        order = Window.partitionBy("node").orderBy("bin")  # at most BINS rows
        bins = bins.withColumn("upto", F.sum("bytes").over(order)).withColumn("rows", F.sum("n").over(order))
        last = F.lead("bin").over(order).isNull()
        reached = bins.withColumn("last", last).where("upto >= goal OR last").groupBy("node").agg(F.min(F.struct("bin", "bytes", "n", "least", "most", "upto", "rows", "splits")).alias("b"))
        for r in reached.collect():  # a row per node
            f, b = found[r["node"]], r["b"]
            found[r["node"]] = Found(b["least"], b["most"] - b["least"] + 1, f.rows_below + b["rows"] - b["n"], f.below + b["upto"] - b["bytes"], b["n"], b["bytes"], b["splits"])
    return found


def _dealt(node: Node, dim: int, point: int, row: int, rows: int, size: int, target: float) -> Cut:
    """The cut with ``rows`` rows of ``size`` bytes to the left, and its shards."""
    left = round(node.k * size / node.bytes) if node.bytes else 1
    if node.rows >= node.k:
        left = min(max(left, node.k - (node.rows - rows)), rows)
    left = min(max(left, 1), node.k - 1)
    even = node.bytes / node.k
    off = max(abs(size / left - even), abs((node.bytes - size) / (node.k - left) - even)) / target
    return Cut(node.first, dim, point, row, left, off)


def _level(rows: DataFrame, nodes: list[Node], target: float, light: float, dims: int) -> dict[int, Cut]:
    """A cut for every node of a level."""
    spark, best = rows.sparkSession, {}
    for turn in range(dims):
        open_nodes = {n.first: n for n in nodes if n.first not in best or best[n.first].off > UNEVEN}
        if not open_nodes:
            break
        goals = {f: n.bytes * (n.k // 2) / n.k for f, n in open_nodes.items()}
        chosen = F.broadcast(small_table(spark, [(f, n.dims[turn][0]) for f, n in open_nodes.items()], "node int, dim int"))  # a row per node
        along = rows.join(chosen, "node").withColumn("key", _point(dims))
        ranges = {f: Found(n.dims[turn][1] << TEXT_BITS, (n.dims[turn][2] - n.dims[turn][1] + 1) << TEXT_BITS) for f, n in open_nodes.items()}
        points = _quantiles(along, ranges, goals, light)
        heavy = {}
        for f, n in open_nodes.items():
            p, dim = points[f], n.dims[turn][0]
            options = [_dealt(n, dim, p.low, 0, p.rows_below, p.below, target), _dealt(n, dim, p.low + p.width, 0, p.rows_below + p.rows, p.below + p.bytes, target)]
            cut = min(options, key=lambda c: c.off)
            if f not in best or cut.off < best[f].off:
                best[f] = cut
            if p.width == 1 and p.splits and p.rows > 1 and p.bytes > light:
                heavy[f] = p
        if heavy:  # a text that no shard can hold
            at = F.broadcast(small_table(spark, [(f, p.low) for f, p in heavy.items()], "node int, heavy long"))  # a row per node
            within = along.join(at, "node").where("key = heavy").select("node", "size", "splits", F.col("row_hash").alias("key"))
            full = {f: Found(0, 1 << ROW_BITS) for f in heavy}
            for f, r in _quantiles(within, full, {f: goals[f] - p.below for f, p in heavy.items()}, light).items():
                p, n = heavy[f], open_nodes[f]
                for row, count, size in ((r.low, r.rows_below, r.below), (r.low + r.width, r.rows_below + r.rows, r.below + r.bytes)):
                    cut = _dealt(n, n.dims[turn][0], p.low, row, p.rows_below + count, p.below + size, target)
                    if cut.off < best[f].off:
                        best[f] = cut
    return best


def _spans(rows: DataFrame, k_of: dict[int, int], dims: int) -> list[Node]:
    """The nodes that are still to be cut: more than one shard and more than one row."""
    ends = [F.struct(F.min(f"d{i}").alias("low"), F.max(f"d{i}").alias("high")).alias(f"d{i}") for i in range(dims)]
    out = []
    for r in rows.where(F.col("node").isin(list(k_of))).groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *ends).collect():  # a row per node
        wide = sorted(((i, r[f"d{i}"]["low"], r[f"d{i}"]["high"]) for i in range(dims - 1)), key=lambda d: (d[1] - d[2], d[0]))
        if r["n"] > 1:
            out.append(Node(r["node"], k_of[r["node"]], r["n"], r["bytes"], [*wide, (dims - 1, r[f"d{dims - 1}"]["low"], r[f"d{dims - 1}"]["high"])]))
    return out


def partitioned(narrow: DataFrame, shards: int, stages: Stages, *, light: float = LIGHT) -> DataFrame:
    """``narrow`` with the number of each row's shard as ``node``: one level of all nodes at a time."""
    dims = len([c for c in narrow.columns if c.startswith("d") and c[1:].isdigit()])
    rows = stages.cut(narrow)
    target = (rows.agg(F.sum("size")).head()[0] or 0) / shards
    # heavier than a shard: fewer than ``shards`` texts
    large = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target).select("text_hash", F.lit(True).alias("large"))
    rows = rows.join(F.broadcast(large), "text_hash", "left").withColumn("splits", F.coalesce("large", F.lit(False))).select(narrow.columns)
    rows = stages.cut(rows)
    k_of = {0: shards} if shards > 1 else {}
    while k_of and (nodes := _spans(rows, k_of, dims)):
        cuts = _level(rows, nodes, target, light * target, dims)
        table = [(c.node, c.dim, c.point, c.row, c.node + c.left) for c in cuts.values()]
        small = F.broadcast(small_table(rows.sparkSession, table, "node int, dim int, point long, row long, right int"))  # a row per node
        right = (F.col("key") > F.col("point")) | ((F.col("key") == F.col("point")) & (F.col("row_hash") >= F.col("row")))
        met = rows.join(small, "node", "left").withColumn("key", _point(dims)).withColumn("node", F.when(right, F.col("right")).otherwise(F.col("node")))
        before, rows = rows, stages.cut(met.select(rows.columns))
        stages.drop(before)
        k_of = {f: k for n in nodes for f, k in ((n.first, cuts[n.first].left), (n.first + cuts[n.first].left, n.k - cuts[n.first].left)) if k > 1}
    return rows


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, counted from 0 within ``shard``; rows in the order of their hashes."""
    rows = rows.withColumn("block", F.shiftrightunsigned("row_hash", ROW_BITS - (BLOCKS - 1).bit_length()).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "block", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row_hash", "doc_id", "text_hash", "size"))
    # counts has at most shards * BLOCKS rows
    return rows.withColumn("place", place).join(F.broadcast(counts), ["shard", "block"]).withColumn("slot", F.col("before") + F.col("place") - 1)


def kd_shards(docs: DataFrame, *, shards: int = 40, light: float = LIGHT) -> DataFrame:
    """One row per document: its size, checksum, shard and slot under the law ``bytes``."""
    with Stages(docs.sparkSession) as stages:
        placed = with_slots(partitioned(narrow_of(docs), shards, stages, light=light).withColumnRenamed("node", "shard"))
        return cut_lineage(
            placed.select(
                "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
            )
        )
