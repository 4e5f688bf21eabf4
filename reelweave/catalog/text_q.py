"""Text and identifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelweave.catalog import standins as st
from reelweave.catalog.registry import cte, query
from reelweave.functions import identifiers as ids
from reelweave.functions import text as tx
from reelweave.operators.fusion import topic_group
from reelweave.session import table

NW = r"[^\p{L}\p{N}_]+"


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(tx.WS + '+')}, ' ', 'g'))"


def norm_text(x: str) -> str:
    return f"lower({sq(f'nfc_normalize({x})')})"


def accents(x: str) -> str:
    return f"translate({x}, {lit(tx.VN_ACCENTED)}, {lit(tx.VN_BASE)})"


def norm_search(x: str) -> str:
    return f"trim(regexp_replace({accents(norm_text(x))}, {lit(NW)}, ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def keyword_list(x: str) -> str:
    stop = ", ".join(lit(w) for w in tx.STOPWORDS)
    return f"list_filter({toks(x)}, lambda t: length(t) >= 2 AND NOT list_contains([{stop}], t))"


def marker(x: str, words) -> str:
    return f"regexp_matches(' ' || {x} || ' ', {lit(' (' + '|'.join(words) + ') ')})"


cte("doc_norm", f"SELECT doc_id, {norm_search('text')} AS n FROM documents")


@query("normalized_text", f"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, {norm_text('text')} AS n FROM documents)")
def normalized_text(spark, d):
    n = tx.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select(
        "doc_id", F.length("n").cast("bigint").alias("n_chars"), F.md5("n").alias("digest")
    )


@query("accent_stripped_text", f"SELECT conv_id, turn, {accents('text')} AS plain FROM conversations")
def accent_stripped_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.strip_accents(F.col("text")).alias("plain"))


@query("search_normalized_text", "SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM doc_norm", ("doc_norm",))
def search_normalized_text(spark, d):
    n = tx.normalize_for_search(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select(
        "doc_id", F.length("n").cast("bigint").alias("n_chars"), F.md5("n").alias("digest")
    )


@query(
    "document_keywords",
    f"SELECT doc_id, len(k) AS n_keywords, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {keyword_list('n')} AS k FROM doc_norm)",
    ("doc_norm",),
)
def document_keywords(spark, d):
    n = table(spark, d, "documents").select("doc_id", tx.normalize_for_search(F.col("text")).alias("n"))
    return n.select("doc_id", tx.keywords(F.col("n")).alias("k")).select(
        "doc_id", F.size("k").cast("bigint").alias("n_keywords"), F.md5(F.array_join("k", " ")).alias("digest")
    )


@query(
    "folded_text",
    r"""SELECT conv_id, turn, replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'ß', 'ss') AS folded,
  regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM conversations""",
)
def folded_text(spark, d):
    """Two mark-free foldings of every message."""
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.fold_marks(F.col("text")).alias("folded"), tx.fold_compat(F.col("text")).alias("plain")
    )


# Query texts: every conversation message inside one of six phrasings.
TEMPLATES = [
    "{t}",
    "The clip begins with {t}, then the words on the left side of the frame. \"Breaking  news\" said 5 minutes",
    "một người đang nói về {t} sau đó \"tin tức\" ở góc trên bên trái màn hình",
    "{t}; from stage to screen at 12:34, followed by a chart and a diagram of the lecture class",
    "E1: {t}\n- the vest on the top of the person -> 2) competition 'slide' and «one  two» and the map",
    "{t}. Tier 1: the teacher wears a vest and the mc speaks for 90 seconds on stage. Top-left of the screen a logo",
]


def message_texts(spark, d):
    c = table(spark, d, "conversations")
    pick = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        before, after = t.split("{t}")
        text = F.when(pick == i, F.concat(F.lit(before), F.col("text"), F.lit(after))).otherwise(text)
    return c.select("conv_id", "turn", "role", text.alias("text"))


def _templates_sql() -> str:
    cases = []
    for i, t in enumerate(TEMPLATES):
        before, after = t.split("{t}")
        cases.append(f"WHEN {i} THEN {lit(before)} || text || {lit(after)}")
    return f"SELECT conv_id, turn, role, CASE (conv_id + turn) % 6 {' '.join(cases)} END AS text FROM conversations"


cte("messages", _templates_sql())
cte("message_norm", f"SELECT conv_id, turn, text, {norm_search('text')} AS n FROM messages", "messages")


def message_norm(spark, d):
    return message_texts(spark, d).withColumn("n", tx.normalize_for_search(F.col("text")))


@query(
    "quoted_screen_text",
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(text, '("[^"\\r\\n]+"|“[^”\\r\\n]+”|«[^»\\r\\n]+»)', 1),
  lambda s: {sq('s[2:-2]')}), lambda s: s <> ''), ' ') AS quoted FROM messages""",
    ("messages",),
)
def quoted_screen_text(spark, d):
    return message_texts(spark, d).select("conv_id", "turn", tx.quoted_spans(F.col("text")).alias("quoted"))


@query(
    "quoted_parts",
    f"""SELECT conv_id, turn, trim(array_to_string(list_transform(list_filter(list_transform(p, lambda s, i: CASE WHEN list_position(p, s) = i THEN s ELSE '' END), lambda s: s <> ''), lambda s: s), ' ')) AS quoted FROM (
  SELECT conv_id, turn, list_transform(list_concat(regexp_extract_all(text, '["“]([^"”]+)["”]', 1), regexp_extract_all(text, '''([^'']+)''', 1)),
    lambda s: regexp_replace(s, {lit('^' + tx.WS + '+|' + tx.WS + '+$')}, '', 'g')) AS p FROM messages)""",
    ("messages",),
)
def quoted_parts(spark, d):
    return message_texts(spark, d).select("conv_id", "turn", tx.quoted_parts(F.col("text")).alias("quoted"))


@query(
    "text_language",
    r"SELECT doc_id, CASE WHEN length(regexp_replace(lower(text), '[\x00-\x7f]', '', 'g')) > length(regexp_replace(lower(text), '[^a-z]', '', 'g')) * 0.3::DOUBLE THEN 'vi' ELSE 'en' END AS language FROM documents",
)
def text_language(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.detect_language(F.col("text")).alias("language"))


def _time_sql() -> str:
    parts = [
        f"CASE WHEN regexp_matches(l, {lit(p)}) THEN CAST(regexp_extract(l, {lit(p)}, 1) AS DOUBLE) * {u} END" for p, u in tx.TIME_PATTERNS
    ]
    c = lit(tx.CLOCK_PATTERN)
    clock = (
        f"CASE WHEN regexp_matches(l, {c}) THEN CAST(regexp_extract(l, {c}, 1) AS DOUBLE) * 60 + CAST(regexp_extract(l, {c}, 2) AS DOUBLE) "
        f"+ coalesce(TRY_CAST(regexp_extract(l, {c}, 3) AS DOUBLE), 0) / 1000 END"
    )
    return f"coalesce({', '.join(parts)}, {clock})"


@query(
    "time_references",
    f"SELECT conv_id, turn, s AS start_seconds, s + 10 AS end_seconds FROM (SELECT conv_id, turn, {_time_sql()} AS s FROM (SELECT conv_id, turn, lower(text) AS l FROM messages)) WHERE s IS NOT NULL",
    ("messages",),
)
def time_references(spark, d):
    m = message_texts(spark, d).select("conv_id", "turn", tx.time_reference(F.col("text")).alias("_t")).filter("_t is not null")
    return m.select("conv_id", "turn", F.col("_t.start").alias("start_seconds"), F.col("_t.end").alias("end_seconds"))


def _synonym_values() -> str:
    rows = [f"({i}, {j}, {lit(p)}, {lit(v)})" for i, (p, vs) in enumerate(tx.SYNONYMS) for j, v in enumerate(vs)]
    return ", ".join(rows)


@query(
    "query_expansion",
    f"""SELECT conv_id, turn, CAST(n - 1 AS INTEGER) AS pos, variant FROM (SELECT conv_id, turn, variant, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) AS n FROM (
  SELECT conv_id, turn, variant, i, j, row_number() OVER (PARTITION BY conv_id, turn, variant ORDER BY i, j) AS first FROM (
    SELECT conv_id, turn, text AS variant, -1 AS i, 0 AS j FROM messages
    UNION ALL SELECT m.conv_id, m.turn, v, i, j FROM message_norm m JOIN (VALUES {_synonym_values()}) s(i, j, p, v) ON contains(m.n, p) OR contains(lower(m.text), p))) WHERE first = 1) WHERE n <= 6""",
    ("messages", "message_norm"),
)
def query_expansion(spark, d):
    m = message_norm(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.expand_query(F.col("text"), F.col("n"))).alias("pos", "variant"))


@query(
    "query_intents",
    f"SELECT conv_id, turn, CASE WHEN {marker('n', tx.OCR_MARKERS)} THEN 'ocr' WHEN {marker('n', tx.ASR_MARKERS)} THEN 'asr' ELSE 'default' END AS intent FROM message_norm",
    ("message_norm",),
)
def query_intents(spark, d):
    return message_norm(spark, d).select("conv_id", "turn", tx.query_intent(F.col("n")).alias("intent"))


@query(
    "visual_query_features",
    f"""SELECT conv_id, turn, {marker('n', tx.LAYOUT_MARKERS)} AS layout, {marker('n', tx.ORDER_MARKERS)} OR regexp_matches(n, '\\bfrom\\b.+\\bto\\b') AS temporal FROM message_norm""",
    ("message_norm",),
)
def visual_query_features(spark, d):
    m = message_norm(spark, d).select("conv_id", "turn", tx.visual_features(F.col("n")).alias("_f"))
    return m.select("conv_id", "turn", F.array_contains("_f", "layout").alias("layout"), F.array_contains("_f", "temporal").alias("temporal"))


@query(
    "temporal_queries",
    f"SELECT conv_id, turn, regexp_matches(n, {lit('|'.join(tx.TEMPORAL_MARKERS))}) AS temporal FROM message_norm",
    ("message_norm",),
)
def temporal_queries(spark, d):
    return message_norm(spark, d).select("conv_id", "turn", tx.is_temporal(F.col("n")).alias("temporal"))


def rex(p: str) -> str:
    """Java pattern as the SQL engine's pattern literal."""
    return lit(p.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)"))


def words_sql(x: str) -> str:
    return f"len({toks(sq(x))})"


def strip_sql(x: str, chars: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{chars}]+|[{chars}]+$')}, '', 'g')"


def first_only(xs: str, key: str = "x") -> str:
    """Order-preserving distinct of a list expression, compared by ``key``."""
    keyed = f"list_transform({xs}, lambda x: {key})"
    return f"list_filter(list_transform({xs}, lambda x, i: CASE WHEN list_position({keyed}, {key}) = i THEN x END), lambda x: x IS NOT NULL)"


def clause_sql(cuts, opening: str) -> str:
    marked = sq("text")
    for p, r in cuts:
        marked = f"regexp_replace({marked}, {rex(p)}, {lit(r.replace('$1', chr(92) + '1'))}, 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda p: {strip_sql(f'regexp_replace(p, {rex(opening)}, {lit(str())})', ' ,.;:-')})"
    return f"""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, c[i] AS clause FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM (
  SELECT conv_id, turn, CASE WHEN w = '' THEN [] WHEN len(k) > 0 THEN k[1:5] ELSE [w] END AS c FROM (
    SELECT conv_id, turn, w, {first_only('q')} AS k FROM (
      SELECT conv_id, turn, w, list_filter(p, lambda x: {words_sql('x')} >= 4) AS q FROM (SELECT conv_id, turn, {sq('text')} AS w, {parts} AS p FROM messages)))))"""


@query("visual_clauses", clause_sql(tx.EN_CUTS, tx.EN_OPENING), ("messages",))
def visual_clauses(spark, d):
    m = message_texts(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.visual_clauses(F.col("text"))).alias("pos", "clause"))


@query("caption_clauses", clause_sql(tx.VI_CUTS, tx.VI_OPENING), ("messages",))
def caption_clauses(spark, d):
    m = message_texts(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.caption_clauses(F.col("text"))).alias("pos", "clause"))


def lock_sql(split_and: bool) -> str:
    raw = "regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g')"
    raw = f"regexp_replace({raw}, {lit('^' + tx.WS + '+|' + tx.WS + '+$')}, '', 'g')"
    raw = f"regexp_replace({raw}, '\n[ \t]*[-•*][ \t]*', chr(10), 'g')"
    parts = f"string_split(regexp_replace(raw, {rex(tx.LOCK_CUT)}, chr(1), 'g'), chr(1))"
    if split_and:
        sides = f"string_split(regexp_replace(p, {rex('(?iu)' + chr(92) + 's+(?:and|và|va)' + chr(92) + 's+')}, chr(1), 'g'), chr(1))"
        parts = (
            f"flatten(list_transform({parts}, lambda p: CASE WHEN len({sides}) = 2 AND {words_sql(sides + '[1]')} >= 5 "
            f"AND {words_sql(sides + '[2]')} >= 5 THEN {sides} ELSE [p] END))"
        )
    return f"""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, c[i] AS clause FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM (
  SELECT conv_id, turn, CASE WHEN raw = '' THEN [] WHEN len(k) > 0 THEN k[1:5] ELSE [{sq('raw')}] END AS c FROM (
    SELECT conv_id, turn, raw, {first_only('q', 'lower(x)')} AS k FROM (
      SELECT conv_id, turn, raw, list_filter(list_transform({parts}, lambda p: {strip_sql('p', ' ,:-')}), lambda x: {words_sql('x')} >= 4) AS q FROM (
        SELECT conv_id, turn, {raw} AS raw FROM messages)))))"""


@query("lock_clauses", lock_sql(False), ("messages",))
def lock_clauses(spark, d):
    m = message_texts(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.lock_clauses(F.col("text"))).alias("pos", "clause"))


@query("lock_clauses_with_and", lock_sql(True), ("messages",))
def lock_clauses_with_and(spark, d):
    m = message_texts(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.lock_clauses(F.col("text"), split_and=True)).alias("pos", "clause"))


# The SQL engine's word boundary knows ASCII only, so the boundary is spelled out.
LATER = tx.LATER_SCENE.replace("(?iuU)\\b", "(?i)(^|[^\\p{L}\\p{N}_])")[:-2] + "(?:[^\\p{L}\\p{N}_]|$)"


@query(
    "primary_clauses",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(w, {lit(LATER)}) AND {words_sql('h')} >= 5 THEN h ELSE w END AS target FROM (
  SELECT conv_id, turn, w, {strip_sql(f"string_split(regexp_replace(w, {lit(LATER)}, {lit(chr(92) + '1')} || chr(1), 'g'), chr(1))[1]", ' ,.;:')} AS h FROM (
    SELECT conv_id, turn, {sq('text')} AS w FROM messages))""",
    ("messages",),
)
def primary_clauses(spark, d):
    return message_texts(spark, d).select("conv_id", "turn", tx.primary_clause(F.col("text")).alias("target"))


def _speech_sql() -> str:
    value = sq("text")
    for p in tx.SPEAKER_WRAPPERS:
        bare = p.replace("(?iuU)", "").replace("(?i)", "")
        value = f"regexp_replace({value}, {lit('(?is)^(.*?)' + bare)}, {lit(chr(92) + '1')})"
    return sq(value)


@query(
    "speech_query_variants",
    f"""SELECT conv_id, turn, role, text FROM (
  SELECT conv_id, turn, 'content' AS role, c AS text FROM (SELECT conv_id, turn, {sq('text')} AS o, {_speech_sql()} AS c FROM messages) WHERE c <> o AND c <> ''
  UNION ALL SELECT conv_id, turn, 'original_fallback', o FROM (SELECT conv_id, turn, {sq('text')} AS o, {_speech_sql()} AS c FROM messages) WHERE c <> o AND c <> '' AND lower(c) <> lower(o)
  UNION ALL SELECT conv_id, turn, 'original', o FROM (SELECT conv_id, turn, {sq('text')} AS o, {_speech_sql()} AS c FROM messages) WHERE NOT (c <> o AND c <> '') AND o <> '')""",
    ("messages",),
)
def speech_query_variants(spark, d):
    m = message_texts(spark, d)
    out = m.select("conv_id", "turn", F.explode(tx.speech_variants(F.col("text"))).alias("_v"))
    return out.select("conv_id", "turn", "_v.role", "_v.text")


cte("low", f"SELECT conv_id, turn, lower({sq('text')}) || ' ' AS l FROM messages", "messages")


def has_sql(words) -> str:
    return f"regexp_matches(l, {lit('|'.join(words))})"


@query(
    "caption_probe_queries",
    f"""SELECT conv_id, turn, CAST(n - 1 AS INTEGER) AS pos, probe FROM (
  SELECT conv_id, turn, probe, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS n FROM (
    SELECT conv_id, turn, 0 AS o, w AS probe FROM (SELECT conv_id, turn, {sq('text')} AS w FROM messages)
    UNION ALL SELECT conv_id, turn, 1, CASE WHEN {has_sql(tx.LECTURE_WORDS)} AND {has_sql(tx.CONTEST_WORDS)} THEN 'teacher explains competition' WHEN {has_sql(tx.LECTURE_WORDS)} THEN 'teacher explains lecture' WHEN {has_sql(tx.CONTEST_WORDS)} THEN 'competition' END FROM low
    UNION ALL SELECT conv_id, turn, 2, CASE WHEN {has_sql(tx.SLIDE_WORDS)} AND {has_sql(tx.CONTEST_WORDS)} THEN 'competition slide' END FROM low
    UNION ALL SELECT conv_id, turn, 3, CASE WHEN {has_sql(tx.MAP_WORDS)} THEN 'map' END FROM low
    UNION ALL SELECT conv_id, turn, 4, CASE WHEN {has_sql(tx.DIAGRAM_WORDS)} THEN 'diagram' END FROM low
    UNION ALL SELECT conv_id, turn, 5, CASE WHEN {has_sql(tx.TRANSITION_WORDS)} THEN 'transition' END FROM low) WHERE probe IS NOT NULL) WHERE n <= 5""",
    ("messages", "low"),
)
def caption_probe_queries(spark, d):
    m = message_texts(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.caption_probes(F.col("text"))).alias("pos", "probe"))


def _region_sql() -> str:
    cases = []
    for region, pattern in tx.REGION_PATTERNS:
        p = pattern
        before = f"regexp_extract(f, {lit('(?s)^(.*?)' + p)}, 1)"
        phrase = f"regexp_extract(f, {lit(p)}, 0)"
        tail = f"substring(f, length({before}) + length({phrase}) + 1)"
        follow = f"regexp_replace({tail}, '^[ ,.;:-]+', '')"
        owner = f"regexp_extract({follow}, {lit('^' + tx.REGION_OWNER)}, 0)"
        skipped = f"CASE WHEN {owner} <> '' THEN length({tail}) - length({follow}) + length({owner}) ELSE 0 END"
        rest = sq(f"substring(w, 1, length({before})) || ' ' || substring(w, length({before}) + length({phrase}) + {skipped} + 1)")
        conf = 0.96 if len(tx.REGION_AXES[region]) == 2 else 0.92
        cases.append(
            f"WHEN regexp_matches(f, {lit(p)}) AND NOT (regexp_matches({follow}, '^(?:cua|of)\\b') AND {owner} = '') "
            f"THEN {{'region': '{region}', 'confidence': {conf}::DOUBLE, 'semantic': CASE WHEN {rest} = '' THEN w ELSE {rest} END, 'source': 'rule'}}"
        )
    return f"CASE {' '.join(cases)} ELSE {{'region': 'full', 'confidence': 0.0::DOUBLE, 'semantic': w, 'source': 'none'}} END"


cte(
    "folded_messages",
    f"""SELECT conv_id, turn, w, replace(replace(strip_accents(lower(w)), 'đ', 'd'), 'ß', 'ss') AS f FROM (SELECT conv_id, turn, {sq('text')} AS w FROM messages)""",
    "messages",
)


def _spatial(spark, d, requested=None):
    m = message_texts(spark, d).select("conv_id", "turn", tx.squeeze(F.col("text")).alias("w"))
    m = m.withColumn("f", tx.fold_marks(F.col("w"))).withColumn("r", F.lit(None).cast("string") if requested is None else requested)
    # the fold is bound once: every region's pattern reads it
    bound = F.transform(F.array(F.struct("w", "f", "r")), lambda x: tx.spatial_query(x["w"], x["f"], None if requested is None else x["r"]))[0]
    return m.select("conv_id", "turn", bound.alias("_s")).select("conv_id", "turn", "_s.region", "_s.confidence", "_s.semantic_text", "_s.source")


@query(
    "spatial_queries",
    f"SELECT conv_id, turn, r.region AS region, r.confidence AS confidence, r.semantic AS semantic_text FROM (SELECT conv_id, turn, {_region_sql()} AS r FROM folded_messages)",
    ("folded_messages",),
)
def spatial_queries(spark, d):
    return _spatial(spark, d).drop("source")


@query(
    "spatial_queries_explicit",
    f"""SELECT conv_id, turn, r.region AS region, r.confidence AS confidence, r.semantic AS semantic_text, r.source AS source FROM (
  SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND w <> '' THEN {{'region': CASE WHEN turn % 2 = 0 THEN 'top_left' ELSE 'right' END, 'confidence': 1.0::DOUBLE, 'semantic': w, 'source': 'explicit'}} ELSE {_region_sql()} END AS r FROM folded_messages)""",
    ("folded_messages",),
)
def spatial_queries_explicit(spark, d):
    """Every third conversation names its region, every other third an unknown one."""
    known = F.when(F.col("turn") % 2 == 0, " Top_Left").otherwise("right")
    asked = F.when(F.col("conv_id") % 3 == 0, known).when(F.col("conv_id") % 3 == 1, "middle").otherwise("auto")
    return _spatial(spark, d, asked)


@query(
    "conversation_context",
    """SELECT conv_id, turn, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS context FROM conversations WHERE role = 'user'""",
)
def conversation_context(spark, d):
    """Last three user messages of each conversation turn."""
    return tx.user_context(table(spark, d, "conversations"))


@query(
    "event_script_split",
    f"""SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, c[i] AS event FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS i FROM (
  SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '\n+|->|→|;', chr(1), 'g'), chr(1)), lambda p:
    regexp_replace(regexp_replace(p, '(?i)^\\s*(e[0-9]+|event\\s*[0-9]+|[0-9]+)\\s*[:.)-]\\s*', ''), {lit('^' + tx.WS + '+|' + tx.WS + '+$')}, '', 'g')), lambda p: p <> '') AS c FROM messages))""",
    ("messages",),
)
def event_script_split(spark, d):
    m = message_texts(spark, d)
    return m.select("conv_id", "turn", F.posexplode(tx.split_events(F.col("text"))).alias("pos", "event"))


@query(
    "lane_texts",
    f"""SELECT conv_id, turn, coalesce(CASE WHEN role = 'system' THEN 'override' END, CASE WHEN turn % 2 = 0 AND q <> '' THEN q END, trim(text)) AS ocr_text, {sq('text')} AS asr_text FROM (
  SELECT conv_id, turn, role, text, array_to_string(list_filter(list_transform(regexp_extract_all(text, '("[^"\r\n]+"|“[^”\r\n]+”|«[^»\r\n]+»)', 1), lambda s: {sq('s[2:-2]')}), lambda s: s <> ''), ' ') AS q FROM messages)""",
    ("messages",),
)
def lane_texts(spark, d):
    """Text routed to the screen-text and speech lanes by mode, override and quotes."""
    m = message_texts(spark, d)
    mode = F.when(F.pmod("turn", F.lit(2)) == 0, "visual_ocr").otherwise("none")
    override = F.when(F.col("role") == "system", "override")
    out = m.select("conv_id", "turn", tx.lane_text(mode, F.col("text"), override, F.lit(None).cast("string")).alias("_t"))
    return out.select("conv_id", "turn", "_t.ocr_text", "_t.asr_text")


@query(
    "topic_groups",
    """SELECT video_id, CASE WHEN regexp_matches(video_id, '(?i)^(L[0-9]+)(_V|_)') THEN upper(regexp_extract(video_id, '(?i)^(L[0-9]+)(_V|_)', 1)) ELSE split_part(video_id, '_', 1) END AS topic, count(*) AS n_frames FROM frames GROUP BY ALL""",
    ("frames",),
)
def topic_groups(spark, d):
    f = st.frames(spark, d)
    return f.groupBy("video_id", topic_group(F.col("video_id")).alias("topic")).agg(F.count(F.lit(1)).alias("n_frames"))


def known_ids(spark, d):
    """Video ids of the order lines: supplier as collection, line number as video."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    return li.select(
        F.concat(F.lit("N"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0"), F.lit("-V"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0")).alias("video_id")
    )


def typed_ids(spark, d):
    """Hand-typed forms of ids: one per supplier and nation, some wrong."""
    s = table(spark, d, "supplier")
    v = F.pmod("s_nationkey", F.lit(9))
    sep = F.when(v == 1, " ").when(v == 2, "-").otherwise("_")
    plain = F.concat(F.lit("n"), F.col("s_suppkey"), sep, F.lit("v"), v)
    return s.select(F.when(v == 3, F.concat(plain, F.lit(".mp4"))).when(v == 4, F.concat(F.lit("N"), F.col("s_suppkey"), F.lit("-VO"), v)).otherwise(plain).alias("typed"))


cte(
    "known_ids",
    "SELECT DISTINCT 'N' || lpad(CAST(l_suppkey AS VARCHAR), 3, '0') || '-V' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS video_id FROM lineitem",
)
cte(
    "typed_ids",
    """SELECT CASE v WHEN 3 THEN 'n' || s_suppkey || '_v' || v || '.mp4' WHEN 4 THEN 'N' || s_suppkey || '-VO' || v ELSE 'n' || s_suppkey || CASE v WHEN 1 THEN ' ' WHEN 2 THEN '-' ELSE '_' END || 'v' || v END AS typed
FROM (SELECT s_suppkey, s_nationkey % 9 AS v FROM supplier)""",
)


def key_sql(x: str) -> str:
    s = f"upper(trim(regexp_replace(trim({x}), '(?i)\\.(mp4|mov|mkv|webm|avi|m4v)$', '')))"
    p = "'^([A-Z]+)0*([0-9]+)[\\s_-]*V0*([0-9]+)$'"
    return f"CASE WHEN regexp_matches({s}, {p}) THEN regexp_extract({s}, {p}, 1) || '|' || CAST(regexp_extract({s}, {p}, 2) AS BIGINT) || '|' || CAST(regexp_extract({s}, {p}, 3) AS BIGINT) END"


@query(
    "typed_video_ids",
    f"""SELECT t.typed, k.video_id FROM typed_ids t LEFT JOIN (SELECT {key_sql('video_id')} AS k, min(video_id) AS video_id FROM known_ids GROUP BY 1) k ON {key_sql('t.typed')} = k.k""",
    ("typed_ids", "known_ids"),
)
def typed_video_ids(spark, d):
    return ids.resolve_video_ids(typed_ids(spark, d), known_ids(spark, d))


@query("video_id_suggestions")
def video_id_suggestions(spark, d):
    """Suggestions for typed ids that resolve to nothing (matching-blocks similarity)."""
    return ids.suggest_video_ids(typed_ids(spark, d), known_ids(spark, d))


@query(
    "time_conversions",
    """SELECT conv_id, turn, CAST(trunc(s * fps) AS BIGINT) AS caption_frame, CAST(round_even(s * fps, 0) AS BIGINT) AS start_frame,
  greatest(CAST(round_even(e * fps, 0) AS BIGINT), CAST(round_even(s * fps, 0) AS BIGINT) + 1) AS end_frame, CAST(floor(n * 1000 / fps + 0.5) AS BIGINT) AS ms,
  CAST(floor((n // 60 * 60 + n % 60) * fps + 0.5) AS BIGINT) AS clock_frame
FROM (SELECT conv_id, turn, 20.3::DOUBLE * turn + length(text) / 100.0::DOUBLE AS s, 20.3::DOUBLE * turn + length(text) / 90.0::DOUBLE AS e, length(text) AS n, CASE WHEN conv_id % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END AS fps FROM conversations)""",
)
def time_conversions(spark, d):
    """Frames, rounded segment ranges, milliseconds and parsed clock times of transcript rows."""
    c = table(spark, d, "conversations")
    n = F.length("text")
    base = c.select(
        "conv_id",
        "turn",
        n.alias("n"),
        (F.lit(20.3) * F.col("turn") + n / F.lit(100.0)).alias("s"),
        (F.lit(20.3) * F.col("turn") + n / F.lit(90.0)).alias("e"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, 25.0).otherwise(29.97).alias("fps"),
    )
    fps = F.col("fps")
    rng = ids.speech_frames(F.col("s"), F.col("e"), fps)
    clock = F.concat((F.col("n") / 60).cast("bigint"), F.lit(":"), F.lpad(F.pmod("n", F.lit(60)).cast("string"), 2, "0"))
    return base.select(
        "conv_id",
        "turn",
        ids.caption_frame(F.col("s"), fps).alias("caption_frame"),
        rng["start_frame"].alias("start_frame"),
        rng["end_frame"].alias("end_frame"),
        ids.frame_to_millis(F.col("n"), fps).alias("ms"),
        ids.parse_clock(clock, fps).alias("clock_frame"),
    )


@query(
    "inherited_weights",
    "SELECT event_id, CASE WHEN value >= 8 THEN 0.6::DOUBLE ELSE round(1 - 0.4::DOUBLE * greatest(0, value) / 8, 9) END AS weight FROM events",
)
def inherited_weights(spark, d):
    from reelweave.operators.lexical import inherited_weight

    return table(spark, d, "events").select("event_id", F.round(inherited_weight(F.col("value")), 9).alias("weight"))


def grams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substring('#' || {x} || '#', i, 2)))"


@query(
    "bigram_similarity",
    f"""SELECT p_partkey, CASE WHEN p_name = p_type THEN 1.0 ELSE round(2.0::DOUBLE * len(list_intersect({grams_sql('p_name')}, {grams_sql('lower(p_type)')})) / (len({grams_sql('p_name')}) + len({grams_sql('lower(p_type)')})), 9) END AS dice FROM part""",
)
def bigram_similarity(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(tx.bigram_dice(F.col("p_name"), F.lower("p_type")), 9).alias("dice"))


@query(
    "retry_windows",
    """SELECT video_id, w, count(*) AS n FROM (SELECT video_id, unnest(CASE WHEN a >= 180 THEN [a] WHEN greatest(a * 3, a + 60) >= 180 THEN [a, 180.0]
  WHEN greatest(greatest(a * 3, a + 60) * 3, greatest(a * 3, a + 60) + 60) >= 180 THEN [a, greatest(a * 3, a + 60), 180.0] END) AS w FROM (SELECT video_id, 10.0::DOUBLE + floor(value) AS a FROM timeline)) GROUP BY ALL""",
    ("timeline",),
)
def retry_windows(spark, d):
    t = st.timeline(spark, d).select("video_id", (F.lit(10.0) + F.floor("value")).alias("a"))
    return t.select("video_id", F.explode(ids.retry_windows(F.col("a"), F.lit(180.0))).alias("w")).groupBy("video_id", "w").agg(F.count(F.lit(1)).alias("n"))


@query(
    "packed_evidence",
    f"""SELECT doc_id, len(ocr) AS n_ocr, md5(ocr) AS ocr_digest, id FROM (SELECT doc_id, substring({sq('text')}, 1, 240) AS ocr, source || ':' || doc_id AS id FROM documents)""",
)
def packed_evidence(spark, d):
    """Candidate JSON lines with clipped evidence, read back for checking."""
    docs = table(spark, d, "documents")
    packed = docs.select("doc_id", tx.pack_evidence(F.lit("kis"), F.concat_ws(":", "source", "doc_id"), {"ocr": F.col("text")}).alias("line"))
    back = packed.select("doc_id", F.from_json("line", "task STRING, id STRING, ocr STRING").alias("_j"))
    return back.select("doc_id", F.length("_j.ocr").cast("bigint").alias("n_ocr"), F.md5("_j.ocr").alias("ocr_digest"), F.col("_j.id").alias("id"))


@query(
    "answer_strings",
    """SELECT event_id, video_id AS media_item, ms AS start_ms, 'QA-' || event_type || '-' || video_id || '-' || ms AS qa, 'TR-' || video_id || '-' || frame_id || ',' || (frame_id + 5) AS sequence
FROM (SELECT *, frame_id * 40 AS ms FROM timeline)""",
    ("timeline",),
)
def answer_strings(spark, d):
    t = st.timeline(spark, d).withColumn("raw", F.concat("video_id", F.lit("_h264")))
    ms = ids.frame_to_millis(F.col("frame_id"), F.lit(25.0))
    return t.select(
        "event_id",
        ids.kis_answer(F.col("raw"), ms)["media_item"].alias("media_item"),
        ids.kis_answer(F.col("raw"), ms)["start"].alias("start_ms"),
        ids.qa_answer(F.col("event_type"), F.col("raw"), ms).alias("qa"),
        ids.sequence_answer(F.col("raw"), F.array(F.col("frame_id"), F.col("frame_id") + 5)).alias("sequence"),
    )


def any_sql(x: str, words) -> str:
    return f"regexp_matches(lower({x}), {lit('|'.join(words))})"


@query(
    "event_predicates",
    f"""SELECT conv_id, turn, {any_sql('text', ids.PROGRESS_MARKERS)} AS forward_bridge,
  role <> 'system' AND {any_sql("'video starts ' || role", ids.OPENING_MARKERS)} AND {any_sql('text', ids.FIRST_MARKERS)} AND {any_sql("text || ' appear'", ids.APPEARANCE_MARKERS)} AS onset_allowed FROM messages""",
    ("messages",),
)
def event_predicates(spark, d):
    m = message_texts(spark, d)
    source = F.when(F.col("role") == "system", "manual_video_start").otherwise("kis_anchor")
    return m.select(
        "conv_id",
        "turn",
        ids.forward_bridge(F.col("text")).alias("forward_bridge"),
        (
            ids.onset_allowed(F.concat("text", F.lit(" appear")), F.concat(F.lit("video starts "), F.col("role")), source)
            & ids.onset_allowed(F.concat("text", F.lit(" first appear")), F.concat(F.lit("video starts "), F.col("role")), source)
        ).alias("onset_allowed"),
    )


@query(
    "document_keys",
    "SELECT video_id, frame_id, video_id || '_' || frame_id AS key, video_id || ':' || frame_id AS doc, video_id || ':' || frame_id || ',-,' || (frame_id + 1) AS seq FROM frames",
    ("frames",),
)
def document_keys(spark, d):
    """Frame keys composed and parsed back."""
    f = st.frames(spark, d)
    keyed = f.select(
        ids.frame_key(F.col("video_id"), F.col("frame_id")).alias("key"),
        ids.frame_key(F.col("video_id"), F.col("frame_id"), ":").alias("doc"),
        ids.sequence_key(F.col("video_id"), F.array(F.col("frame_id"), F.lit(None).cast("bigint"), F.col("frame_id") + 1)).alias("seq"),
    )
    return keyed.select(
        ids.parse_frame_key(F.col("key"))["video_id"].alias("video_id"), ids.parse_document_key(F.col("doc"))["frame_id"].alias("frame_id"), "key", "doc", "seq"
    )
