"""The registered queries, and the same in SQL for another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..functions import markers as m
from ..operators import audit, rewrite, routing, style, text, web
from . import seeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, seed: str) -> DataFrame:
    # In the SQL's engine concat passes over a null text.
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(seed.replace("concat(text,", "concat(coalesce(text, ''),")).alias("text"))


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- the invisible-character pass -------------------------------------------------------------


def _pass_sql(tail: str, aggressive: bool = False, glue: bool = False) -> str:
    stripped = f"({cp.STRIPPED} OR {cp.within('cp', cp.FORMAT)}" + ("" if glue else f" AND NOT {cp.within('cp', cp.ORTHOGRAPHIC)}") + ")"
    look = f"WHEN {cp.one_of('cp', [ord(c) for c in cp.LOOKALIKES])} THEN 97 " if aggressive else ""
    frame = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH s AS (SELECT doc_id, {seeds.TEXT} AS text FROM documents),
l AS (SELECT doc_id, string_split(text, '') AS chars FROM s),
c AS (SELECT doc_id, unnest(range(0, len(chars))) AS pos, unnest(chars) AS ch FROM l),
k AS (SELECT *, CAST(unicode(ch) AS INTEGER) AS cp FROM c),
b AS (SELECT *, CASE WHEN {cp.within("cp", cp.GLUE)} OR {stripped} THEN NULL WHEN {cp.one_of("cp", cp.SPACES)} THEN 32 {look}ELSE cp END AS base FROM k),
p AS (SELECT *, last_value(base IGNORE NULLS) {frame} AS prev, last_value(CASE WHEN base IS NOT NULL THEN CASE base WHEN 97 THEN 'a' ELSE ch END END IGNORE NULLS) {frame} AS prev_ch, coalesce(sum(CASE WHEN cp > 65535 THEN 2 ELSE 1 END) {frame}, 0) AS place FROM b),
x AS (SELECT *, coalesce({cp.kept_by_context(glue, 'regexp_matches', '')}, false) AS context FROM p),
d AS (SELECT *, {cp.kind(aggressive, True, glue)} AS kind FROM x)
{tail}"""


_cleaned = (
    "SELECT doc_id, md5(string_agg(CASE WHEN kind IS NULL THEN ch WHEN kind = 'space-homoglyph' THEN ' '"
    " WHEN kind = 'latin-confusable' THEN translate(ch, '{0}', '{1}') ELSE '' END, '' ORDER BY pos)) AS text_md5,"
    " CAST(count(*) FILTER (kind IS NOT NULL AND kind NOT IN ('space-homoglyph', 'latin-confusable')) AS BIGINT) AS removed_count,"
    " CAST(count(*) FILTER (kind IN ('space-homoglyph', 'latin-confusable')) AS BIGINT) AS replaced_count FROM d GROUP BY doc_id"
).format("".join(cp.LOOKALIKES), "".join(cp.LOOKALIKES.values()))


@query(_pass_sql(f"SELECT doc_id, cp AS codepoint, kind, count(*) AS n, CAST(min(place) AS BIGINT) AS first_offset, printf('U+%04X', cp) AS label, {cp.category()} AS category, {cp.name()} AS name, CASE WHEN kind IN ('space-homoglyph', 'latin-confusable') THEN 'informational' ELSE 'probable' END AS confidence FROM d WHERE kind IS NOT NULL GROUP BY doc_id, cp, kind"))
def text_inspect_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.hits(docs(spark, sf_dir, seeds.TEXT))
    return found.select("doc_id", "codepoint", "kind", "n", F.col("sample_offsets")[0].alias("first_offset"), "label", "category", "name", "confidence")


def _cleaned_query(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    out = text.clean(docs(spark, sf_dir, seeds.TEXT), text.TextOptions(**options))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "removed_count", "replaced_count")


@query(_pass_sql(_cleaned))
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_query(spark, sf_dir)


@query(_pass_sql(_cleaned, glue=True))
def text_strip_emoji_glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_query(spark, sf_dir, strip_emoji_glue=True)


@query(_pass_sql(_cleaned, aggressive=True))
def text_confusables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned_query(spark, sf_dir, aggressive=True)


@query(_pass_sql("SELECT kind, count(DISTINCT doc_id) AS docs, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY kind"))
def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.hits(docs(spark, sf_dir, seeds.TEXT), samples=1).groupBy("kind", "doc_id").agg(F.sum("n").alias("n"))
    return found.groupBy("kind").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("n"))


@query(_pass_sql(f"SELECT cp AS codepoint, {cp.name()} AS name, count(*) AS n FROM d WHERE kind IS NOT NULL GROUP BY cp"))
def text_clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.hits(docs(spark, sf_dir, seeds.TEXT), samples=1).groupBy("codepoint", "name").agg(F.sum("n").cast("long").alias("n"))


@query(_pass_sql(f"SELECT doc_id, count(*) AS kept FROM d WHERE kind IS NULL AND {cp.STRIPPED} GROUP BY doc_id"))
def text_keep_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.decisions(docs(spark, sf_dir, seeds.TEXT)).filter(F.col("kind").isNull() & F.expr(cp.STRIPPED)).groupBy("doc_id").agg(F.count("*").alias("kept"))


# --- prose statistics -------------------------------------------------------------------------

_words = r"SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}''-]*'), lambda x: lower(x)) AS w FROM documents"
_lines = r"""l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM seeded),
f AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, sum(CASE WHEN regexp_replace(line, '^\s+', '') LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS fences FROM l),
j AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS t FROM f WHERE fences % 2 = 0 AND t <> '' AND t NOT LIKE '```%' GROUP BY doc_id),
sent AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM j)"""
_fenced = "CASE WHEN doc_id % 3 = 0 THEN concat('```' || chr(10) || 'code. here! x' || chr(10) || '```' || chr(10), text) ELSE text END"


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM ({_words})")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", style.word_list(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def _fenced_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "CASE WHEN doc_id % 3 = 0 THEN concat('```\ncode. here! x\n```\n', text) ELSE text END")


@query(f"WITH seeded AS (SELECT doc_id, {_fenced} AS text FROM documents), {_lines} SELECT doc_id, count(*) AS n_sentences, max(length(s)) AS longest FROM sent GROUP BY doc_id")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _fenced_docs(spark, sf_dir).select("doc_id", F.explode(style.sentence_list(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).cast("long").alias("longest"))


_cv = r"n AS (SELECT doc_id, CAST(len(regexp_extract_all(s, '[\p{L}\p{N}][\p{L}\p{N}''-]*')) AS DOUBLE) AS n FROM sent), cv AS (SELECT doc_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_samp(n) / avg(n) END AS cv FROM n WHERE n > 0 GROUP BY doc_id)"


@query(f"WITH seeded AS (SELECT doc_id, text FROM documents), {_lines}, {_cv} SELECT doc_id, CAST(floor(coalesce(cv, 0) * 10000 + 0.500001) AS BIGINT) AS cv_e4 FROM documents LEFT JOIN cv USING (doc_id)")
def burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.burstiness(table(spark, sf_dir, "documents")).select("doc_id", F.floor(F.col("cv") * 10000 + 0.500001).cast("long").alias("cv_e4"))


def _mattr(source: str) -> str:
    words_of = _words.replace("FROM documents", f"FROM {source}")
    return f"""w AS ({words_of}),
q AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
v AS (SELECT *, coalesce(lag(j) OVER (PARTITION BY doc_id, word ORDER BY j), 0) AS p FROM q),
mattr AS (SELECT doc_id, sum(CASE WHEN n > 50 THEN greatest(0, least(j, n - 49) - greatest(1, j - 49, p + 1) + 1) / (50.0 * (n - 49)) WHEN p = 0 THEN 1.0 / n ELSE 0 END) AS mattr FROM v GROUP BY doc_id)"""


@query(f"WITH {_mattr('documents')} SELECT doc_id, CAST(floor(mattr * 1000000 + 0.500001) AS BIGINT) AS mattr_e6 FROM mattr")
def mattr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.moving_ratio(table(spark, sf_dir, "documents")).select("doc_id", F.floor(F.col("mattr") * 1000000 + 0.500001).cast("long").alias("mattr_e6"))


_esc = lambda s: s.replace("'", "''")
_phrase_rows = " UNION ALL ".join(f"SELECT doc_id, '{_esc(label)}' AS phrase, CAST(len(regexp_extract_all(text, '{_esc(style.phrase_regex_re2(body, after))}')) AS BIGINT) AS n, CAST({weight} AS DOUBLE) AS weight FROM seeded" for label, weight, body, after in style.PHRASES)
_phrases = f"phrase AS (SELECT * FROM ({_phrase_rows}) WHERE n > 0)"


@query(f"WITH seeded AS (SELECT doc_id, {seeds.PHRASES} AS text FROM documents), {_phrases} SELECT * FROM phrase")
def phrase_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.phrases(docs(spark, sf_dir, seeds.PHRASES))


_d = lambda s: re.sub(r"(?<=\d)D", "", s)


@query(f"""WITH seeded AS (SELECT doc_id, {seeds.PHRASES} AS text FROM documents), {_lines}, {_cv}, {_mattr("seeded")}, {_phrases},
ns AS (SELECT doc_id, count(*) AS n_sentences FROM sent GROUP BY doc_id), wt AS (SELECT doc_id, sum(n * weight) AS weighted FROM phrase GROUP BY doc_id),
a AS (SELECT doc_id, len(w.w) AS n_words, coalesce(n_sentences, 0) AS n_sentences, coalesce(cv, 0) AS cv, coalesce(mattr, 0) AS mattr, coalesce(weighted, 0) / (greatest(len(w.w), 1) / 100.0) AS density
  FROM w LEFT JOIN ns USING (doc_id) LEFT JOIN cv USING (doc_id) LEFT JOIN mattr USING (doc_id) LEFT JOIN wt USING (doc_id)),
r AS (SELECT *, CASE WHEN n_words >= 30 THEN least(1.0, greatest(0.0, ({_d(style.BURST + " ")} * 0.45 + {_d(style.DENSE + " ")} * 0.45 + {_d(style.DIVERSE + " ")} * 0.1) * {_d(style.DAMP + " ")})) ELSE 0 END AS raw FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(floor(raw * 1000000 + 0.500001) AS BIGINT) AS score_e6,
  CASE WHEN raw >= 0.75 THEN 'HIGH' WHEN raw >= 0.5 THEN 'MEDIUM' WHEN raw >= 0.25 THEN 'LOW' ELSE 'CLEAN' END AS level, CASE WHEN n_words >= 30 THEN 'ok' ELSE 'insufficient-length' END AS status FROM r""")
def stylometry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = style.score(docs(spark, sf_dir, seeds.PHRASES), raw=True)
    return s.select("doc_id", "n_words", "n_sentences", F.floor(F.col("raw") * 1000000 + 0.500001).cast("long").alias("score_e6"), "level", "status")


# --- markers ----------------------------------------------------------------------------------

_view = r"SELECT doc_id, lower(regexp_replace({0}, '[^\x20-\x7e]', '.', 'g')) AS view FROM documents".format(seeds.MARKERS)


def _viewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, seeds.MARKERS).select("doc_id", F.lower(F.regexp_replace("text", r"[^\x20-\x7e]", ".")).alias("view"))


@query(f"SELECT doc_id, {m.listed('view', m.C2PA)} AS c2pa, {m.listed('view', m.PROVENANCE)} AS provenance FROM ({_view})")
def marker_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir).selectExpr("doc_id", f"{m.listed('view', m.C2PA)} AS c2pa", f"{m.listed('view', m.PROVENANCE)} AS provenance")


_privacy = ", ".join(f"{m.holds('view', needles)} AS has_{label}" for label, needles in m.PRIVACY.items())


@query(f"SELECT doc_id, {_privacy} FROM ({_view})")
def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir).selectExpr("doc_id", *(f"{m.holds('view', needles)} AS has_{label}" for label, needles in m.PRIVACY.items()))


@query(f"SELECT confidence, count(*) AS n FROM (SELECT {m.confidence('view')} AS confidence FROM ({_view})) GROUP BY confidence")
def marker_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _viewed(spark, sf_dir).selectExpr(f"{m.confidence('view')} AS confidence").groupBy("confidence").agg(F.count("*").alias("n"))


# --- audit ------------------------------------------------------------------------------------

_labels = "list_filter([" + ", ".join(f"CASE WHEN {m.holds('view', needles)} THEN '{label}' END" for label, needles in m.PRIVACY.items()) + "], lambda x: x IS NOT NULL)"
_audit = _pass_sql(f""", hits AS (SELECT doc_id, cp, kind, count(*) AS n, CASE WHEN kind IN ('space-homoglyph', 'latin-confusable') THEN 'informational' ELSE 'probable' END AS confidence FROM d WHERE kind IS NOT NULL GROUP BY doc_id, cp, kind),
mk AS (SELECT doc_id, {m.holds("view", m.C2PA)} AS has_c2pa, {m.holds("view", m.PROVENANCE)} AS has_ai_metadata, {_labels} AS privacy, {m.confidence("view")} AS mc FROM ({_view})),
fd AS (SELECT doc_id, confidence FROM hits UNION ALL SELECT doc_id, mc FROM mk WHERE mc IS NOT NULL),
sc AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS suspicious_total FROM hits GROUP BY doc_id),
fr AS (SELECT doc_id, count(*) AS n_findings, CAST(sum({m.RANK.format(c="confidence")}) AS BIGINT) AS rank_sum, max({m.RANK.format(c="confidence")}) AS top,
  count(*) FILTER (confidence = 'confirmed') AS n_confirmed, count(*) FILTER (confidence = 'probable') AS n_probable, count(*) FILTER (confidence = 'informational') AS n_informational FROM fd GROUP BY doc_id),
au AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' ELSE 'text' END AS format, source, has_c2pa, has_ai_metadata, privacy, coalesce(suspicious_total, 0) AS suspicious_total, coalesce(n_findings, 0) AS n_findings,
  coalesce(rank_sum, 0) AS rank_sum, coalesce(n_confirmed, 0) AS n_confirmed, coalesce(n_probable, 0) AS n_probable, coalesce(n_informational, 0) AS n_informational,
  CASE top WHEN 3 THEN 'confirmed' WHEN 2 THEN 'probable' WHEN 1 THEN 'informational' ELSE 'none' END AS highest_confidence
  FROM documents JOIN mk USING (doc_id) LEFT JOIN sc USING (doc_id) LEFT JOIN fr USING (doc_id)),
aud AS (SELECT *, has_c2pa OR len(privacy) > 0 OR suspicious_total > 0 OR n_confirmed + n_probable > 0 AS actionable,
  CAST(rank_sum * 10 + len(privacy) * 25 + CASE WHEN has_c2pa THEN 40 ELSE 0 END + CASE WHEN suspicious_total > 0 THEN 15 ELSE 0 END AS BIGINT) AS weight FROM au)
""")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = text.hits(docs(spark, sf_dir, seeds.TEXT), samples=1).select("doc_id", "n", "confidence")
    marks = audit.marker_items(docs(spark, sf_dir, seeds.MARKERS), "doc_id", "text")
    # The hits are read once, for the findings and for their total.
    findings = hits.unionByName(marks.filter("marker_confidence IS NOT NULL").select("doc_id", F.lit(0).cast("long").alias("n"), F.col("marker_confidence").alias("confidence")))
    base = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' ELSE 'text' END").alias("format"))
    items = base.join(marks, "doc_id")
    return audit.audit_items(items, findings, "doc_id")


@query(_audit + "SELECT doc_id, format, has_c2pa, has_ai_metadata, array_to_string(privacy, ',') AS privacy, suspicious_total, n_findings, actionable, weight, highest_confidence FROM aud")
def audit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select("doc_id", "format", "has_c2pa", "has_ai_metadata", F.array_join("privacy", ",").alias("privacy"), "suspicious_total", "n_findings", "actionable", "weight", "highest_confidence")


_has = lambda x: f"count(*) FILTER (list_contains(privacy, '{x}')) AS with_{x}"


@query(_audit + f"SELECT count(*) AS total, count(*) FILTER (actionable) AS actionable, count(*) FILTER (has_c2pa) AS with_c2pa, count(*) FILTER (has_ai_metadata) AS with_ai_metadata, count(*) FILTER (suspicious_total > 0) AS with_invisible_text, {_has('location')}, {_has('device')}, {_has('author')}, {_has('timestamps')}, CAST(0 AS BIGINT) AS findings_likely_false_positive, CAST(sum(n_informational) AS BIGINT) AS findings_informational, CAST(sum(n_probable) AS BIGINT) AS findings_probable, CAST(sum(n_confirmed) AS BIGINT) AS findings_confirmed FROM aud")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audited(spark, sf_dir))


@query(_audit + "SELECT format, count(*) AS items, count(*) FILTER (actionable) AS actionable FROM aud GROUP BY format")
def audit_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).groupBy("format").agg(F.count("*").alias("items"), F.count_if("actionable").alias("actionable"))


@query(_audit + "SELECT confidence, count(*) AS n FROM fd GROUP BY confidence")
def audit_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = audit.summary(audited(spark, sf_dir))
    return s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("confidence"), F.col(f"findings_{c.replace('-', '_')}").alias("n")) for c in audit.RANKS))).alias("x")).select("x.*").filter("n > 0")


@query(_audit + "SELECT doc_id, weight FROM aud ORDER BY weight DESC, doc_id")
def audit_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, worst first."""
    return audited(spark, sf_dir).select("doc_id", "weight").orderBy(F.desc("weight"), "doc_id")


@query(_audit + "SELECT format, highest_confidence, count(*) AS items, CAST(sum(weight) AS BIGINT) AS weight FROM aud GROUP BY ROLLUP (format, highest_confidence)")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).rollup("format", "highest_confidence").agg(F.count("*").alias("items"), F.sum("weight").cast("long").alias("weight"))


@query(_audit + "SELECT quality, toxic, count(*) AS items, count(*) FILTER (actionable) AS actionable FROM aud JOIN labels USING (doc_id) GROUP BY quality, toxic")
def audit_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("items"), F.count_if("actionable").alias("actionable"))


_verdict = "concat_ws(', ', CASE WHEN has_c2pa THEN 'C2PA manifest' WHEN has_ai_metadata THEN 'AI provenance metadata' END, CASE WHEN {c}(privacy, 'location') THEN 'location' END, CASE WHEN {c}(privacy, 'device') THEN 'device identity' END, CASE WHEN {c}(privacy, 'author') THEN 'author identity' END, CASE WHEN {c}(privacy, 'timestamps') THEN 'timestamps' END)"
_said = "CASE WHEN {v} <> '' THEN {v} WHEN n_confirmed + n_probable > 0 THEN concat(CAST(n_confirmed + n_probable AS VARCHAR(9)), ' metadata block', CASE WHEN n_confirmed + n_probable = 1 THEN '' ELSE 's' END, ' carrying unclassified content') ELSE 'no metadata found' END"


@query(_audit + f"SELECT doc_id, has_c2pa OR has_ai_metadata OR len(privacy) > 0 OR n_confirmed + n_probable > 0 AS flagged, highest_confidence, {_said.format(v=_verdict.format(c='list_contains'))} AS summary FROM aud")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdict.format(c="array_contains")
    return audited(spark, sf_dir).selectExpr("doc_id", "has_c2pa OR has_ai_metadata OR size(privacy) > 0 OR n_confirmed + n_probable > 0 AS flagged", "highest_confidence", f"{_said.format(v=v)} AS summary")


# --- HTML, Markdown, SVG ----------------------------------------------------------------------

_q = lambda s: s.replace("'", "''")
_attr = lambda n: "list_extract(regexp_extract_all(tag, '" + _q(r"""(?i)NAME\s*=\s*["']([^"']*)["']""").replace("NAME", n) + "', 1), -1)"
_html_sql = f"""
WITH h AS (SELECT page_id, {seeds.HTML} AS html FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_q(web.META)}')) AS tag FROM h),
a AS (SELECT *, lower(coalesce({_attr("name")}, {_attr("property")}, {_attr("generator")}, '')) = 'generator' AND NOT regexp_matches(tag, '{m.AI_VENDOR_RE2}') AS cms,
  regexp_matches(tag, '{m.AI_NAME}') OR regexp_matches(tag, '{m.AI_VENDOR_RE2}') AS ai, regexp_matches(coalesce({_attr("name")}, {_attr("property")}, ''), '{web.IDENTITY}') AS ident FROM t),
f AS (
  SELECT page_id, CASE WHEN cms THEN 'html.meta.cms-generator' WHEN ai THEN 'html.meta.ai' WHEN ident THEN 'html.meta.identity' END AS code,
    CASE WHEN cms THEN 'informational' WHEN ai AND NOT regexp_matches(tag, '{m.AI_VENDOR_RE2}') THEN 'probable' ELSE 'confirmed' END AS confidence FROM a
  UNION ALL SELECT page_id, 'html.jsonld.provenance', 'confirmed' FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_q(web.JSON_LD)}')) AS b FROM h) WHERE regexp_matches(b, '{m.AI_NAME}') OR regexp_matches(b, '{web.JSON_CLAIM}')
  UNION ALL SELECT page_id, 'html.attr.data-ai', 'probable' FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_q(web.DATA_AI)}')) AS b FROM h))
SELECT page_id, code, confidence, count(*) AS n FROM f WHERE code IS NOT NULL GROUP BY page_id, code, confidence"""


def _pages(spark: SparkSession, sf_dir: str, seed: str = seeds.HTML, name: str = "html") -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(seed).alias(name))


@query(_html_sql)
def html_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.html_findings(_pages(spark, sf_dir)).groupBy("page_id", "code", "confidence").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '<meta name="generator" content="ChatGPT">', ''), '<meta property="c2pa" content="x">', ''),
  '<script type="application/ld+json">{{"a": "trainedAlgorithmicMedia"}}</script>', ''), '{_q(web.DATA_AI)}', '', 'g')) AS html_md5 FROM (SELECT page_id, {seeds.HTML} AS html FROM pages)""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.md5(web.clean_html(F.col("html"))).alias("html_md5"))


_md = f"""
WITH s AS (SELECT doc_id, {seeds.FRONT} AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(regexp_extract(text, '^---\\n((?s:.*?))\\n---', 1), chr(10))) AS line FROM s),
k AS (SELECT doc_id, regexp_extract(line, '^([A-Za-z0-9_.-]+)[ \\t]*:', 1) AS key, trim(substring(line, instr(line, ':') + 1)) AS value FROM l WHERE NOT regexp_matches(line, '^[ \\t-]') AND trim(line) <> '' AND line NOT LIKE '#%'),
c AS (SELECT *, lower(key) IN ({", ".join(f"'{x}'" for x in m.AI_KEYS)}) OR regexp_matches(key, '{m.AI_NAME}') AS named FROM k WHERE key <> '')
SELECT doc_id, 'markdown.frontmatter.generator' AS code, key AS at, 'confirmed' AS confidence FROM c WHERE named
UNION ALL SELECT doc_id, 'markdown.frontmatter.value', key, 'probable' FROM c WHERE NOT named AND regexp_matches(value, '{m.AI_NAME}')
UNION ALL SELECT doc_id, 'markdown.frontmatter.identity', key, 'informational' FROM c WHERE lower(key) IN ({", ".join(f"'{x}'" for x in m.IDENTITY_KEYS)})"""


@query(_md)
def md_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = web.front_lines(docs(spark, sf_dir, seeds.FRONT))
    own = lines.filter("code IS NOT NULL").select("doc_id", "code", F.col("key").alias("at"), "confidence")
    return own.unionByName(lines.filter("identity").select("doc_id", F.lit("markdown.frontmatter.identity").alias("code"), F.col("key").alias("at"), F.lit("informational").alias("confidence")))


@query("""SELECT doc_id, md5('---' || chr(10) || 'title: x' || chr(10) || 'author: y' || chr(10) || CASE doc_id % 5 WHEN 3 THEN 'date: 2020' || chr(10) ELSE '' END || '---' || chr(10) || text) AS text_md5 FROM documents""")
def md_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.clean_markdown(docs(spark, sf_dir, seeds.FRONT)).select("doc_id", F.md5("text").alias("text_md5"))


_svg = " UNION ALL ".join(
    f"SELECT page_id, '{code}' AS code, '{confidence}' AS confidence FROM s WHERE {test}"
    for code, confidence, test in [
        ("svg.metadata.block", "confirmed", f"regexp_matches(svg, '{web.SVG['metadata']}')"),
        ("svg.xmp", "confirmed", f"(regexp_matches(svg, '{web.SVG['xmp']}') OR regexp_matches(svg, '(?i)<\\?xpacket'))"),
        ("svg.c2pa", "probable", "regexp_matches(svg, '(?i)c2pa|jumbf')"),
        ("svg.editor.attrs", "confirmed", f"regexp_matches(svg, '{web.SVG['attrs']}')"),
        ("svg.vendor.name", "probable", f"regexp_matches(svg, '{m.AI_VENDOR_RE2}')"),
    ]
)


@query(f"WITH s AS (SELECT page_id, {seeds.SVG} AS svg FROM pages) {_svg}")
def svg_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(F.array(*web.svg_findings(F.col("svg"))), lambda x: x.isNotNull())
    return _pages(spark, sf_dir, seeds.SVG, "svg").select("page_id", F.explode(found).alias("f")).select("page_id", "f.code", "f.confidence")


@query("""SELECT page_id, CASE page_id % 3 WHEN 1 THEN '<svg xmlns="s"><!-- plain --><g/></svg>' ELSE '<svg xmlns="s"><g/></svg>' END AS svg FROM pages""")
def svg_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, seeds.SVG, "svg").select("page_id", web.clean_svg(F.col("svg")).alias("svg"))


# --- routing and URLs -------------------------------------------------------------------------

_name = "concat('f', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.md' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.docx' WHEN 4 THEN '.py' ELSE '' END)"


@query(f"SELECT doc_id, {_name} AS name, CASE doc_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'container' WHEN 3 THEN 'container' WHEN 4 THEN 'text' END AS kind FROM documents")
def classify_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_name).alias("name")).withColumn("kind", web.kind_of_name(F.col("name")))


@query("""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png; x=1' WHEN 1 THEN 'TEXT/HTML' ELSE 'application/x-any' END AS type, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, type, list_extract(list_filter(string_split(path, '/'), lambda s: s <> ''), -1) AS last FROM p)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'page.png' WHEN page_id % 4 = 1 THEN 'page.html' WHEN contains(last, '.') THEN last ELSE 'page.html' END AS name FROM q""")
def filename_for_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'image/png; x=1' WHEN 1 THEN 'TEXT/HTML' ELSE 'application/x-any' END")
    return table(spark, sf_dir, "pages").select("page_id", web.filename_for_url(F.col("url"), kind).alias("name"))


@query(f"""WITH a AS (SELECT event_id, {seeds.ADDRESS} AS address, user_id % 256 AS a, event_id % 256 AS b FROM events)
SELECT event_id, address, a IN (0, 10, 127) OR a >= 224 OR (a = 192 AND b IN (0, 168)) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 100 AND b BETWEEN 64 AND 127) AS private FROM a""")
def private_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(seeds.ADDRESS).alias("address")).withColumn("private", web.private_address(F.col("address")))


_url = "CASE page_id % 5 WHEN 0 THEN replace(url, '://', '://u:p@') WHEN 1 THEN concat('ftp', url) WHEN 2 THEN 'http://169.254.169.254/x' WHEN 3 THEN 'nothing' ELSE url END"


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'credentials' WHEN 1 THEN 'scheme' WHEN 2 THEN 'private' WHEN 3 THEN 'invalid' END AS refused FROM pages")
def url_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.url_policy(F.expr(_url)).alias("refused"))


@query("SELECT page_id, 1 AS pos, url AS loc FROM pages UNION ALL SELECT page_id, 2, 'http://b.example/?a=1&b=2' FROM pages")
def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = table(spark, sf_dir, "pages").select("page_id", F.expr(seeds.SITEMAP).alias("xml"))
    return maps.select("page_id", F.posexplode(web.sitemap_urls(F.col("xml"))).alias("pos", "loc")).withColumn("pos", F.col("pos") + 1)


# --- rewrite scoring --------------------------------------------------------------------------

_tok = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_bi = "list_distinct(CASE WHEN len({0}) < 2 THEN [] ELSE list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) END)"
_pairs = f"""WITH t AS (SELECT conv_id, turn, text AS cand, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS orig FROM conversations),
k AS (SELECT *, {_tok.format("orig")} AS a, {_tok.format("cand")} AS b FROM t WHERE orig IS NOT NULL),
g AS (SELECT *, {_bi.format("a")} AS x, {_bi.format("b")} AS y FROM k),
s AS (SELECT *, len(list_intersect(x, y)) AS shared FROM g),
d AS (SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0.0 WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 WHEN len(x) + len(y) - shared = 0 THEN 0.0 ELSE 1 - shared / CAST(len(x) + len(y) - shared AS DOUBLE) END AS div, length(cand) / CAST(length(orig) AS DOUBLE) AS ratio FROM s),
e AS (SELECT *, div - CASE WHEN ratio > 2 OR ratio < 0.5 THEN 0.15 ELSE 0 END AS score FROM d)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    t = table(spark, sf_dir, "conversations")
    return t.withColumn("orig", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("orig IS NOT NULL")


@query(_pairs + " SELECT conv_id, turn, CAST(floor(div * 1000000 + 0.500001) AS BIGINT) AS divergence_e6 FROM e")
def lexical_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.floor(rewrite.divergence(F.col("orig"), F.col("text")) * 1000000 + 0.500001).cast("long").alias("divergence_e6"))


@query(_pairs + ", b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS r, count(*) OVER (PARTITION BY conv_id) AS candidates FROM e) SELECT conv_id, turn AS best, CAST(floor(score * 1000000 + 0.500001) AS BIGINT) AS score_e6, candidates FROM b WHERE r = 1")
def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rewrite.select_candidate(_turns(spark, sf_dir), "conv_id", "turn", "orig", "text")
    return best.select("conv_id", "best", F.floor(F.col("score") * 1000000 + 0.500001).cast("long").alias("score_e6"), "candidates")


@query(_pairs + " SELECT conv_id, turn, CASE WHEN div < 0.2 OR len(b) > 400 THEN 'higher' WHEN len(b) < 60 THEN 'lower' ELSE 'moderate' END AS risk FROM e")
def assess_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", rewrite.residual_risk(F.col("orig"), F.col("text")).alias("risk"))


@query("SELECT item_id, 'Into French: ' || text || ' (French only)' AS prompt FROM benchmark")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", rewrite.prompt(F.lit("Into {LANGUAGE}: {TEXT} (French only)"), F.col("text"), F.lit("French")).alias("prompt"))


# --- time windows -----------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, CAST(floor(sum(value) * 100 + 0.500001) AS BIGINT) AS value_e2 FROM events GROUP BY 1, 2")
def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.audit import hourly

    return hourly(table(spark, sf_dir, "events")).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.floor(F.col("value") * 100 + 0.500001).cast("long").alias("value_e2"))


# --- binary files -----------------------------------------------------------------------------


def _images(spark: SparkSession, sf_dir: str, kind: str = "image") -> DataFrame:
    """One built file per document."""
    import pyarrow as pa

    def build(batches):
        from ..operators.batches import few
        from . import blobs

        for b in few(batches):
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([getattr(blobs, kind)(i) for i in ids], pa.binary())], names=["name", "content"])

    return table(spark, sf_dir, "documents").select("doc_id").mapInArrow(build, "name string, content binary")


_n = "doc_id % 3 AS form, doc_id // 3 % 4 AS what"
_found = """CASE form
  WHEN 0 THEN ['', 'png.chunk.exif:confirmed', 'png.chunk.text.identity:confirmed,png.chunk.time:confirmed', 'png.chunk.c2pa:confirmed,png.chunk.text.ai:confirmed'][what + 1]
  WHEN 1 THEN ['', 'jpeg.app1.exif:confirmed', 'jpeg.com:informational,jpeg.app13.iptc:confirmed', 'jpeg.app11.jumbf:confirmed,jpeg.app.markers:probable,jpeg.app1.xmp:informational'][what + 1]
  ELSE ['', 'webp.chunk.exif:confirmed', 'webp.chunk.xmp:informational', 'webp.chunk.c2pa:confirmed,webp.chunk.xmp.markers:probable'][what + 1] END"""
_away = """CASE WHEN what = 1 THEN 'author,device,location' WHEN what = 2 THEN ['author,timestamps', 'author', 'device'][form + 1] ELSE '' END"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS name, ['png', 'jpeg', 'webp'][form + 1] AS format, what = 3 AS has_c2pa, what = 3 AS has_ai_metadata, {_away} AS privacy, {_found} AS findings FROM (SELECT doc_id, {_n} FROM documents)")
def image_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.images import inspect_images

    got = inspect_images(_images(spark, sf_dir), "name")
    return got.select("name", "format", "has_c2pa", "has_ai_metadata", F.array_join("privacy", ",").alias("privacy"), F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit(":"), f["confidence"])), ",").alias("findings"))


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS name, CASE form WHEN 0 THEN ['', 'eXIf=1', 'tEXt=1,tIME=1', 'caBX=1,iTXt=1'][what + 1] WHEN 1 THEN ['', 'APP1=1', 'APP13=1,COM=1', 'APP11=1,APP1=1'][what + 1]
  ELSE ['', 'EXIF=1', 'XMP=1', 'C2PA=1,XMP=1'][what + 1] END AS dropped, true AS clean FROM (SELECT doc_id, {_n} FROM documents)""")
def image_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stripping drops, and that nothing is found in the output."""
    from ..operators.images import inspect_images, strip_images

    out = strip_images(_images(spark, sf_dir), "name")
    dropped = F.array_join(F.array_sort(F.transform(F.map_entries("dropped"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    after = inspect_images(out.select("name", "output"), "name", "output").select("name", (F.size("findings") == 0).alias("clean"))
    return out.select("name", dropped.alias("dropped")).join(after, "name")


@query()
def image_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.images import image_parts as parts

    return parts(_images(spark, sf_dir), "name")


_planted = "CASE doc_id % 5 WHEN 0 THEN '00FF41' WHEN 1 THEN 'C3A9C328' WHEN 2 THEN 'EDA080' WHEN 3 THEN 'E282' ELSE '' END"


@query(f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(1 AS BIGINT) WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS n_escaped, md5(encode(replace(text, 'e', 'E')) || unhex({_planted})) AS bytes_md5 FROM documents")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with undecodable bytes at the end, rewritten as text and back: those bytes must survive."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"concat(encode(text, 'utf-8'), unhex({_planted}))").alias("raw"))
    upper = routing.through_codec(lambda t: t.replace("e", "E"))
    return raw.select("doc_id", routing.escaped_bytes("raw").alias("n_escaped"), F.md5(upper("raw")).alias("bytes_md5"))


# Contents that begin in several ways, and what a reader of the magic table expects of each.
_starts = [
    ("504B0304", "a ZIP container (DOCX, ODT, XLSX, PPTX, EPUB, JAR)", "text"), ("255044462D312E34", "a PDF", "container"), ("89504E470D0A1A0A", "a PNG image", "image"),
    ("FFD8FFE0", "a JPEG image", "image"), ("1F8B08", "a gzip archive", "text"), ("4100", "binary data (contains NUL bytes)", "text"),
    ("3C68746D6C3E", None, "container"), ("20203C21444F43545950452048544D4C3E", None, "container"), ("3C3F786D6C3F3E3C737667", None, "container"), ("", None, "text"),
    ("7F454C46", "an ELF binary", "text"), ("0102030405060708", None, "text"),
]
_pick = lambda values: "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"
_blob = "concat(unhex({0}), encode(text, 'utf-8'))".format(_pick([x[0] for x in _starts]))


@query(f"SELECT doc_id, CASE WHEN doc_id % 12 = 11 AND 8.0 / least(8192, 8 + strlen(text)) > 0.05 THEN 'binary data (dense in control bytes)' ELSE {_pick([x[1] for x in _starts])} END AS looks_like, {_pick([x[2] for x in _starts])} AS kind FROM documents")
def sniff_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.expr(_blob).alias("raw"))
    return raw.select("doc_id", routing.sniff_binary(F.col("raw")).alias("looks_like"), routing.classify(F.col("raw"), F.lit(None).cast("string")).alias("kind"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '[^/]*$') IN ('', '.', '..') THEN NULL ELSE left(regexp_extract(url, '[^/]*$'), 255) END AS base, regexp_replace(url, '(\\.[^./]*)?$', '.cleaned\\1') AS cleaned FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", routing.safe_filename(F.col("url")).alias("base"), routing.cleaned_path(F.col("url")).alias("cleaned"))


@query("SELECT doc_id, md5(nfc_normalize(text) || 'fix 1/2 A') AS text_md5 FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms at the end of plain texts become plain."""
    plain = table(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    return plain.select("doc_id", F.md5(routing.nfkc(F.concat("text", F.lit("\ufb01x 1/2 \uff21")))).alias("text_md5"))


_office = """CASE doc_id % 2
  WHEN 0 THEN ['', 'docx.identity:confirmed,docx.timestamps:confirmed', 'docx.customxml:informational,docx.identity:confirmed,docx.part.ai:probable'][what + 1]
  ELSE ['', 'odt.meta.dc.creator:confirmed,odt.meta.dc.date:confirmed', 'odt.meta.meta.generator:confirmed,odt.meta.user-defined:informational'][what + 1] END"""


@query(f"SELECT CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 2 WHEN 0 THEN 'docx' ELSE 'odt' END AS format, what = 2 AS has_ai_metadata, {_office} AS findings FROM (SELECT doc_id, doc_id // 2 % 3 AS what FROM documents)")
def office_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.archives import inspect_documents

    return inspect_documents(_images(spark, sf_dir, "office"), "name").select("name", "format", "has_ai_metadata", F.array_join("findings", ",").alias("findings"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, '' AS left_over, CAST(3 AS BIGINT) AS entries FROM documents")
def office_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inspection still finds after cleaning, and the entries kept."""
    from ..operators.archives import cleaned_documents

    return cleaned_documents(_images(spark, sf_dir, "office"), "name").select("name", F.array_join("findings", ",").alias("left_over"), "entries")
