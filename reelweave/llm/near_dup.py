"""Near-duplicate documents with SetSketch registers.

A document's set are its distinct shingles of ``SHINGLE`` words (A-Z lower-cased; fewer
words form one shingle). A link joins two documents with
``100 * intersection >= THRESHOLD * union``; components of links are groups, and the
document with the least id of a group stays.

1. Every set becomes a sketch: per register the least of exponentially distributed hashes
   of its shingles, of which only the place on an exponentially spaced scale (base ``BASE``)
   is kept, truncated to 16 bits. Sketches of parts merge by taking the larger register.
   Documents with equal sets are one class from here on; a class is one row however many
   copies it has.
2. Bands of ``ROWS`` registers are hashed. Classes that share a band are candidates. Each
   is first compared with the anchor of the band only, the class that shares most with
   others, so a band of any size yields as many pairs as it has classes; what has not
   joined the anchor gets a second one among itself (``ANCHORS`` rounds). Pairs whose joint likelihood, given all registers and
   both set sizes, puts the similarity ``SLACK`` or more below the threshold are dropped;
   all others are verified on the full sets.
3. Verified links give components after each round. Bands whose classes are all in one component are done.
   The classes of the other bands, and only they, go through an exact join: each class
   lists its rarest shingles, as many as must hold one shared shingle with any partner
   (prefix filter), and classes of different components that share a listed one and have
   possible sizes are verified too. Nothing is capped; common passages are no listed
   shingles, because rare ones come first.
4. Components are taken over the links of both steps.

A link is missed only if its classes share no band at all: with 32 bands of 4 that is
5e-6 at similarity 0.75 and less above.

Nulls: null, empty and blank texts have empty sets and are linked with nothing. A null id
belongs to its text's group, never names one, and is kept only if the group has no other
id. Repeated rows are linked (equal sets) and share their id. ``kept`` says this of ids;
where ids are null or repeated, ``deduplicated`` still leaves one row of each group. An
empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from reelweave.llm.common import bounded_batches, connected_components, cut_lineage
from reelweave.llm.words import runs

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Scale of the registers: values 0 .. 65535 hold -log_BASE(x) + OFFSET.
BASE, OFFSET = 1.001, 20_000
SLACK = 0.2
ANCHORS = 2
KEPT_WORDS = 200_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.random.default_rng(1).integers(1, 2**62, size=(3, max(REGISTERS, SHINGLE)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, known: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > KEPT_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * _ODD[0, k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set: REGISTERS 16-bit values."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):  # a long set in parts: sketches merge
        x = shingles[at : at + 2048, None] * _ODD[1, None, :REGISTERS]
        x ^= x >> np.uint64(32)
        x *= _ODD[2, None, :REGISTERS]
        np.minimum(least, x.min(axis=0), out=least)
    # a uniform number gives an exponential one; its scale place is monotone, so the least is placed
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    place = np.floor(OFFSET - np.log(-np.log1p(-u)) / np.log(BASE))
    return np.clip(place, 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum likelihood of the similarity per pair, given registers and set sizes.

    ``a`` and ``b`` are (pairs, registers). With u, v the shares of the union's rate, a
    register of the first is above, below or equal to the second's with probabilities
    p(u - vJ), p(v - uJ) and the rest, p(x) = -log_b(1 - x (b - 1) / b).
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    best = np.zeros(len(a))
    top = np.full(len(a), -np.inf)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    for j in np.linspace(0, 1, 101):
        limit = np.minimum(j, np.minimum(u / v, v / u))
        hi, lo = np.maximum(p(u - v * limit), 1e-12), np.maximum(p(v - u * limit), 1e-12)
        like = above * np.log(hi) + below * np.log(lo) + equal * np.log(np.maximum(1 - hi - lo, 1e-12))
        better = like > top
        best[better], top[better] = limit[better], like[better]
    return best


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class, registers`` of every document: the text's last use but for verification."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, part in runs([t or "" for t in texts]):
                sizes, names, sketches = [], [], []
                for text in part:
                    s = shingle_set(text, known)
                    sizes.append(len(s))
                    names.append(class_of(s))
                    sketches.append(registers(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(part)), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sketches, pa.binary())],
                    ["doc_id", "n_shingles", "class", "registers"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bounded_batches(rows).mapInArrow(tasks, "doc_id long, n_shingles long, class binary, registers binary")


def banded(classes: DataFrame) -> DataFrame:
    """``band, class``: a row per class and band of its registers."""
    parts = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])
    return classes.select("class", F.explode(parts).alias("band"))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that the sketches do not rule out."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sketch = [np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, REGISTERS) for c in ("ra", "rb")]
                n = [part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb")]
                keep = likeliest(*sketch, *n) >= THRESHOLD / 100 - SLACK
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    side = classes.select("class", "n_shingles", "registers")
    rows = pairs.join(side.toDF("a", "na", "ra"), "a")
    rows = rows.join(side.toDF("b", "nb", "rb"), "b").where("100 * least(na, nb) >= 75 * greatest(na, nb)".replace("75", str(THRESHOLD)))
    return rows.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tasks, "a binary, b binary")


def shingled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``class, shingles`` of the classes in ``members (doc_id, class)``, from one document each."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, part in runs(texts):
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(start, len(part)), pa.array([shingle_set(t, known).tobytes() for t in part], pa.binary())], ["class", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(members, "doc_id").select("class", "text").mapInArrow(tasks, "class binary, shingles binary")


def class_of(shingles: np.ndarray) -> bytes | None:
    """The name of a set; the empty one has none."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def unclear_ids(rows: DataFrame) -> DataFrame:
    """``unclear``: the ids that do not name one row, null among them; a stored table."""
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    return cut_lineage(ids.select(F.col("doc_id").alias("unclear")))


def of_unclear(docs: DataFrame, unclear: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is null or repeated."""
    named = docs.join(unclear, docs["doc_id"].cast("long") == unclear["unclear"], "left_semi")
    return named.unionByName(docs.where(docs["doc_id"].isNull()))


def shingled_unclear(docs: DataFrame, unclear: DataFrame, members: DataFrame) -> DataFrame:
    """``class, shingles`` of the classes in ``members (class)``, found by the texts themselves."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            for _, part in runs([t or "" for t in batch.column("text").to_pylist()]):
                sets = [shingle_set(t, known) for t in part]
                yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["class", "shingles"])

    texts = bounded_batches(of_unclear(docs.select("doc_id", "text"), unclear).select("text"))
    return texts.mapInArrow(tasks, "class binary, shingles binary").join(members, "class", "left_semi").dropDuplicates(["class"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose full sets are similar enough."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= THRESHOLD * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(tasks, "a binary, b binary")


def rare_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share one of their rarest shingles (exact).

    Shingles are ordered by the number of classes that have them. The larger class of a
    pair is looked up by its ``n - ceil(t n) + 1`` rarest, the smaller one is listed under
    its ``n - ceil(2 t / (1 + t) n) + 1`` rarest, and at the first shingle two classes share
    their positions must leave room for the overlap that a link needs.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                arrays = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
                n = np.array([len(x) for x in arrays], dtype=np.int64)
                who = pa.array(np.repeat(np.arange(len(arrays)), n))
                flat = pa.array(np.concatenate(arrays) if len(arrays) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("class").take(who), flat, pa.array(np.repeat(n, n))], ["class", "shingle", "n"])

    tokens = sets.mapInArrow(listed, "class binary, shingle long, n long")
    tokens = cut_lineage(tokens)
    common = tokens.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one class only hold no pair, but they are the rarest and take the first places
    seen = tokens.join(common, "shingle").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("held"))
    first = F.col("n") - F.size("held")
    asked = F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100.0) + 1
    keys = seen.withColumn("first", first).where(asked > F.col("first"))
    keys = keys.select("class", "n", "first", F.posexplode(F.slice("held", F.lit(1), (asked - F.col("first")).cast("int"))).alias("i", "key"))
    place = (F.col("first") + F.col("i")).alias("place")
    filed = F.col("first") + F.col("i") < F.col("n") - F.ceil(F.col("n") * 2 * THRESHOLD / (100.0 + THRESHOLD)) + 1
    keys = keys.select("class", "n", place, filed.alias("filed"), "key.shingle")
    keys = cut_lineage(keys.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")))
    # a key whose classes are all of one component is done
    mixed = keys.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    keys = keys.join(mixed, "shingle", "left_semi")
    a, b = keys.where("filed").drop("filed").toDF("shingle", "a", "na", "pa", "xa"), keys.drop("filed").toDF("shingle", "b", "nb", "pb", "xb")
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    room = (100 + THRESHOLD) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= THRESHOLD * (F.col("na") + F.col("nb"))
    close = smaller & room & (F.col("xa") != F.col("xb")) & (100 * F.col("na") >= THRESHOLD * F.col("nb"))
    return a.join(b, "shingle").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the component each ``class`` is in so far."""
    if roots is None:
        return rows.withColumn("root", F.col("class"))
    return rows.drop("root").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))


def components(links: DataFrame) -> DataFrame:
    return cut_lineage(connected_components(links).select(F.col("node").alias("class"), "root"))


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class, component_id, kept`` of every document."""
    return rooted(docs)[0].drop("root")


def rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``grouped`` with the class ``root`` that names a group, and the ids that do not name one row, if any."""
    rows = cut_lineage(sketched(docs))
    unclear = unclear_ids(rows)
    unclear = None if unclear.isEmpty() else unclear
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = cut_lineage(classes)
    sizes = banded(classes).groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(banded(classes).join(sizes, "band"))
    # an original shares more bands, and larger ones, than any of its copies
    fame = cut_lineage(shared.groupBy("class").agg(F.sum("n").alias("fame")))
    members = classes.select("doc_id", "class").join(fame, "class", "left_semi")
    if unclear is None:
        sets = shingled(docs, members)
    else:
        clear = members.where("doc_id IS NOT NULL").join(unclear, F.col("doc_id") == F.col("unclear"), "left_anti")
        others = members.join(clear.select("class"), "class", "left_anti").select("class")
        sets = shingled(docs, clear).unionByName(shingled_unclear(docs, unclear, others))
    sets = cut_lineage(sets)
    left = shared.select("band", "class").join(fame, "class")
    links = tried = roots = None
    for _ in range(ANCHORS):
        left = cut_lineage(with_roots(left, roots))
        anchors = left.groupBy("band").agg(F.max(F.struct("fame", "class", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        anchors = anchors.where("lo <> hi").select("band", F.col("top.class").alias("anchor"), F.col("top.root").alias("anchor_root"))
        pairs = left.join(anchors, "band").where("root <> anchor_root")
        pairs = pairs.select(F.least("class", "anchor").alias("a"), F.greatest("class", "anchor").alias("b")).distinct()
        pairs = cut_lineage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = cut_lineage(verified(cut_lineage(likely(pairs, classes)), sets))
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        # what joined its band's anchor leaves the band
        now = with_roots(anchors.select("band", F.col("anchor").alias("class")), roots).select("band", F.col("root").alias("done"))
        left = with_roots(left, roots).join(now, "band").where("root <> done").drop("done")
    # classes of the bands that still hold several components
    placed = with_roots(shared.select("band", "class"), roots)
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    rest = placed.join(mixed, "band", "left_semi").select("class").distinct()
    more = rare_pairs(cut_lineage(sets.join(rest, "class", "left_semi")), roots).join(tried, ["a", "b"], "left_anti")
    more = cut_lineage(verified(cut_lineage(likely(more, classes)), sets))
    roots = components(links.unionByName(more))
    groups = cut_lineage(with_roots(classes.select("class", "doc_id"), roots))
    named = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    groups = groups.join(named, "root").select("class", "component_id", "root")
    out = rows.select("doc_id", "n_shingles", "class").join(groups, "class", "left")
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), unclear


def one_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of rows whose ids are unclear, one of every group that such an id names or that has no id.

    ``groups (class, component_id, root)``. Empty sets are groups of their id; those without an id all stay.
    """
    columns = docs.columns
    taken = set(map(str.lower, columns))
    cls, root, top, place = (next(n for i in range(len(taken) + 1) if (n := f"_{x}{i}") not in taken) for x in ("class", "root", "top", "place"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            names = [class_of(shingle_set(t, known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, cls])

    rows = bounded_batches(docs).mapInArrow(tasks, StructType([*docs.schema.fields, StructField(cls, BinaryType())]))
    rows = rows.join(groups.toDF(cls, top, root), cls, "left")
    none = F.col(cls).isNull()
    named = rows.where(none | F.col("doc_id").cast("long").eqNullSafe(F.col(top)))
    free = none & F.col("doc_id").isNull()
    order = Window.partitionBy(root, F.when(none, F.col("doc_id"))).orderBy("text")
    first = named.where(~free).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return first.select(*columns).unionByName(named.where(free).select(*columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns unchanged: one row of each group, and those with empty sets."""
    rows, unclear = rooted(docs)
    if unclear is not None:
        rows = cut_lineage(rows)
    gone = rows.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    gone = gone.where("_gone IS NOT NULL")
    if unclear is None:
        gone = cut_lineage(gone.distinct())
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    # unclear ids are settled by their rows' texts
    gone = cut_lineage(gone.unionByName(unclear.where("unclear IS NOT NULL").toDF("_gone")).distinct())
    clear = docs.where(docs["doc_id"].isNotNull())
    clear = clear.join(gone, clear["doc_id"] == gone["_gone"], "left_anti")
    groups = cut_lineage(rows.where("class IS NOT NULL").select("class", "component_id", "root").distinct())
    return clear.unionByName(one_each(of_unclear(docs, unclear), groups))
