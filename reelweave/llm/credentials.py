"""Secret scan with multipart credential linking, in SQL expressions only.

Three strong kinds are reported wherever they stand: assigned values (``assign``), access
key ids (``access``) and long hexadecimal runs (``hex``). Three weak kinds are everyday text
by themselves and are reported only next to the parts that would complete a credential:

* ``ident``, a named account or client id: where a secret part is near,
* ``secret``, a free run of 32 or more mixed letters and digits: where an identifier is near,
* ``endpoint``, a web address: where both a secret part and an identifier are near.

Identifiers are ``access`` and ``ident``; secret parts are ``assign``, ``hex`` and
``secret``. Near means at most ``scope`` code points between the two spans. A free run that
overlaps an assigned value, an identifier or an address is part of that and no secret of its
own. Weak parts complete each other whether or not they are reported.

Matches are leftmost and do not overlap within a kind; those that fail their length or
their mixture are dropped after matching. Offsets are code points, the end exclusive: each text is
split at its matches once a kind, and a running sum over pieces and matches gives
the places. Texts are read in one pass and not moved; only spans are. The interval join cuts a
document into cells as long as the scope. A cell keeps the first start and the last end of its
identifiers and of its secret parts, which is enough to decide nearness exactly, because a
candidate widened by the scope is longer than a cell. So a cell meets a candidate once, and no
pairs of parts are formed in a text full of them.

A null text is empty: no spans. Texts of any length are read whole. Repeated rows are rows,
null ids are kept, an empty table gives no rows. Ties of a start go by kind. Other
columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelweave.llm.common import cut_lineage

SCOPE = 200


def either_case(words: str) -> str:
    """A pattern's letters in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.islower() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGNED = "(" + either_case("password|passwd|secret|token|api_?key") + ")" + _SET + "([A-Za-z0-9+/_.=-]+)"
NAMED = "(" + either_case("client_?id|access_?key_?id|account|username|user|login") + ")" + _SET + "([A-Za-z0-9_.@-]+)"

#: Kind, pattern, what a match must be besides. The order decides ties of a start.
KINDS = [
    ("assign", ASSIGNED, lambda m: F.length(F.regexp_extract(m, ASSIGNED, 2)) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20),
    # a run that is long enough is matched whole; shorter ones need not be listed
    ("hex", "[0-9a-f]{24,}", lambda m: F.lit(True)),
    ("ident", NAMED, lambda m: F.length(F.regexp_extract(m, NAMED, 2)) >= 3),
    ("secret", "[A-Za-z0-9+/_-]{32,}", lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")),
    ("endpoint", r"https?://[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]+)?", lambda m: F.lit(True)),
]
NAMES = [k for k, _, _ in KINDS]
STRONG = {"assign", "access", "hex"}
IDENTIFIERS = {"access", "ident"}
SECRETS = {"assign", "hex", "secret"}


def _kind(names: set[str]) -> Column:
    return F.col("kind").isin([NAMES.index(n) for n in sorted(names)])


def _pieces(number: int, text: Column) -> Column:
    """Lengths of what stands before each match, of the match, and whether it counts; null without a match."""
    _, pattern, counts = KINDS[number]
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.length(m).alias("n"), counts(m).alias("counts")))
    return F.when(text.rlike(pattern), F.struct(F.lit(number).alias("kind"), gaps.alias("gaps"), found.alias("found")))


def located(scanned: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of every match that counts."""
    by_kind = scanned.select("row", F.explode(F.filter("parts", lambda p: p.isNotNull())).alias("p"))
    steps = by_kind.select("row", "p.kind", F.posexplode(F.arrays_zip("p.gaps", "p.found")).alias("i", "z"))
    steps = steps.select("row", "kind", "i", F.col("z.gaps").cast("long").alias("gap"), F.col("z.found.n").cast("long").alias("n"), F.col("z.found.counts").alias("counts"))
    reach = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(Window.partitionBy("row", "kind").orderBy("i"))
    steps = steps.withColumn("end", reach).where("counts")  # the piece after the last match has none
    return steps.select("row", "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def own_parts(spans: DataFrame) -> DataFrame:
    """Without free runs that overlap an assigned value, an identifier or an address."""
    holder = _kind({"assign", "access", "ident", "endpoint"})
    in_order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(holder, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(holder, F.col("start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    # spans of one start stand in the order of kinds, so an address at the run's start comes after it
    inside = (F.coalesce(before > F.col("start"), F.lit(False))) | (F.coalesce(after < F.col("end"), F.lit(False)))
    return spans.withColumn("inside", inside).where(~_kind({"secret"}) | ~F.col("inside")).drop("inside")


def near(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans with ``by_identifier`` and ``by_secret``: whether such a part is within the scope."""
    cell = lambda at: F.floor(at / F.lit(scope))
    role = F.when(_kind(IDENTIFIERS), "identifier").when(_kind(SECRETS), "secret")
    parts = spans.withColumn("role", role).where("role IS NOT NULL")
    parts = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_first")
    last = lambda r: F.max(F.when(F.col("role") == r, F.col("end"))).alias(f"{r}_last")
    cells = parts.groupBy("row", "cell").agg(*[f(r) for r in ("identifier", "secret") for f in (first, last)])
    weak = spans.where(~_kind(STRONG)).withColumn("low", F.col("start") - scope).withColumn("high", F.col("end") + scope)
    weak = weak.withColumn("cell", F.explode(F.sequence(F.greatest(cell(F.col("low")), F.lit(0)), cell(F.col("high")))))
    met = weak.join(cells, ["row", "cell"])
    touches = lambda r: F.coalesce((F.col(f"{r}_first") <= F.col("high")) & (F.col(f"{r}_last") >= F.col("low")), F.lit(False))
    return met.groupBy("row", "kind", "start", "end").agg(F.max(touches("identifier")).alias("by_identifier"), F.max(touches("secret")).alias("by_secret"))


def credentials(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """``doc_id, spans`` with all spans as ``array<struct<kind, start, end>>`` in their order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = cut_lineage(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array(*[_pieces(i, text) for i in range(len(KINDS))]).alias("parts")))
    spans = cut_lineage(own_parts(located(scanned)))
    complete = (
        F.when(_kind({"ident"}), F.col("by_secret"))
        .when(_kind({"secret"}), F.col("by_identifier"))
        .otherwise(F.col("by_identifier") & F.col("by_secret"))
    )
    weak = near(spans, scope).where(complete).select("row", "kind", "start", "end")
    shown = spans.where(_kind(STRONG)).unionByName(weak)
    # one row's spans are those of one text
    listed = shown.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    name = F.array(*map(F.lit, NAMES))
    named = F.transform("s", lambda s: F.struct(name[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    listed = listed.select("row", named.alias("spans"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return scanned.select("doc_id", "row").join(listed, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the strong kinds, digest of their places, all spans as text."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    strong = F.filter("spans", lambda s: s["kind"].isin(sorted(STRONG)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(strong).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def oracle(scope: int = SCOPE) -> str:
    """Places by the same patterns, nearness by comparing spans with each other."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    keep = {
        "assign": f"length(regexp_extract(m, {q(ASSIGNED)}, 2)) >= 6",
        "access": "length(m) >= 20",
        "hex": "length(m) >= 24",
        "ident": f"length(regexp_extract(m, {q(NAMED)}, 2)) >= 3",
        "secret": "length(m) >= 32 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')",
        "endpoint": "true",
    }
    patterns = {k: p for k, p, _ in KINDS} | {"hex": "[0-9a-f]+", "secret": "[A-Za-z0-9+/_-]+"}
    pieces = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, string_split_regex(t, {q(patterns[k])}) AS gs, regexp_extract_all(t, {q(patterns[k])}) AS ms FROM d WHERE regexp_matches(t, {q(patterns[k])})" for i, k in enumerate(NAMES)
    )
    counts = " ".join(f"WHEN {i} THEN {keep[k]}" for i, k in enumerate(NAMES))
    touch = f"o.r = s.r AND o.b <= s.e + {scope} AND o.e >= s.b - {scope}"
    by = lambda kinds: f"EXISTS (SELECT 1 FROM own o WHERE {touch} AND o.kind IN ({', '.join(str(NAMES.index(k)) for k in sorted(kinds))}))"
    line = lambda cond: f"coalesce(string_agg(k || ':' || b || ':' || e, ',' ORDER BY b, kind) FILTER (WHERE {cond}), '')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT r, kind, unnest(gs) AS g, unnest(ms) AS m, generate_subscripts(gs, 1) AS i FROM ({pieces})),
l AS (SELECT r, kind, m, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY r, kind ORDER BY i)::BIGINT AS e FROM p),
f AS MATERIALIZED (SELECT r, kind, e - length(m) AS b, e FROM l WHERE m IS NOT NULL AND CASE kind {counts} END),
own AS MATERIALIZED (SELECT * FROM f s WHERE kind <> 4 OR NOT EXISTS (SELECT 1 FROM f o WHERE o.r = s.r AND o.kind IN (0, 1, 3, 5) AND o.b < s.e AND o.e > s.b)),
shown AS (SELECT *, ['assign', 'access', 'hex', 'ident', 'secret', 'endpoint'][kind + 1] AS k FROM own s WHERE kind < 3
  OR (kind = 3 AND {by(SECRETS)}) OR (kind = 4 AND {by(IDENTIFIERS)}) OR (kind = 5 AND {by(SECRETS)} AND {by(IDENTIFIERS)}))
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
  count(*) FILTER (WHERE kind = 2) AS n_hex, sha256({line('kind < 3')}) AS base_sha256, {line('kind IS NOT NULL')} AS spans
FROM d LEFT JOIN shown ON d.r = shown.r GROUP BY d.r"""
