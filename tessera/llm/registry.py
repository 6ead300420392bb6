"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat import render_maximal
from tessera.llm.decontaminate import contaminated, find_contamination
from tessera.llm import langid, quality, secrets
from tessera.llm.htmltext import extract_text
from tessera.llm.linededup import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.toxicity import CATEGORIES, fit_chain, low_quality_and_toxic, score
from tessera.llm.workspace import read


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Toxic from this probability on: on held-out labelled rows the clean ones stay under it by far.
TOXIC_FROM = 0.35


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a chain (low quality, then toxic) for every document, and whether it is toxic."""
    docs = read(spark, sf_dir, "documents")
    chain = fit_chain(docs, low_quality_and_toxic(read(spark, sf_dir, "labels")), CATEGORIES)
    return score(docs, chain, CATEGORIES).select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC_FROM).alias("toxic"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that 13-word windows of benchmark items cover, and whose items they are."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, its branches weighed by the style tree of its host."""
    return extract_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of the quality rules over every document and the verdict of the current policy."""
    rows = quality.ledger(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.rejected_by("base").alias("base_failed"),
        (~quality.rejected_by("base") & ~quality.rejected_by(quality.CURRENT)).alias("kept"), "fail_bits",
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS r(i)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) AS x, unnest(range(i, i + 5)) AS r(p) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), n AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, (n_words < 10)::BIGINT AS b0, (100 * n_repeat_words > 20 * n_words)::BIGINT AS b1, (10 * n_symbols > n_words)::BIGINT AS b2,
         (2 * n_dup_lines > n_lines)::BIGINT AS b3, (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT AS b4
  FROM n
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       b0 + b1 > 0 AS base_failed, b0 + b1 + b2 + b3 + b4 = 0 AS kept, b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 AS fail_bits
FROM f
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, alone and with others, from the ledger's masks."""
    return quality.ablations(quality.ledger(read(spark, sf_dir, "documents"), carry=()))


_BITS = ("too_short", "repeated_windows", "symbols", "repeated_lines", "word_length")
ABLATIONS_SQL = f"""
WITH led AS (SELECT fail_bits FROM ({OP5_SQL})
), asked(policy, mask, rule, bit) AS (VALUES {", ".join(f"('{v}', {sum(1 << k for k in own)}, '{_BITS[k]}', {1 << k})" for v, own in (("base", (0, 1)), ("v1", range(5))) for k in own)})
SELECT policy, rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & mask <> 0) AS n_rejected, count(*) FILTER (WHERE fail_bits & mask = bit) AS n_only_this
FROM led, asked GROUP BY policy, rule
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square root of their size, in shuffled order."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_copies", "copy", "shuffle_key")


OP6_SQL = """
WITH d AS (SELECT *, greatest(coalesce(length(text), 0), 1) AS points FROM documents
), s AS (SELECT source, CAST(sum(points) AS DOUBLE) AS points FROM d GROUP BY source
), r AS (SELECT source, (sqrt(points) / (SELECT sum(sqrt(points)) FROM s)) * (SELECT sum(points) FROM s) / points AS rate FROM s
), r2 AS (SELECT source, greatest(CAST(ceil(rate / 16) AS INT), 1) AS draws, rate / greatest(CAST(ceil(rate / 16) AS INT), 1) AS step FROM r
), cdf AS (
  SELECT source, k, sum(exp(-step + k * ln(step) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM r2, range(0, 97) AS g(k)
), u AS (
  SELECT doc_id, d.source, text, CAST('0x' || substr(md5('1:copies|' || doc_id || '|' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN r2 ON d.source IS NOT DISTINCT FROM r2.source, unnest(range(1, draws + 1)) AS t(j)
), n AS (
  SELECT doc_id, u.source, text, count(*) FILTER (WHERE c <= u) AS n_copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source GROUP BY ALL
)
SELECT doc_id, source, text, CAST(n_copies AS BIGINT) AS n_copies, copy, md5('1:order|' || doc_id || '|' || copy) AS shuffle_key
FROM n, unnest(range(1, n_copies + 1)) AS t(copy)
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that aren't the beginning of a longer one, rendered."""
    return render_maximal(read(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
), p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-'), chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS pre,
         string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS rendered
  FROM t
), whole AS (SELECT pre, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies, any_value(rendered) AS rendered FROM p WHERE pos = n GROUP BY pre)
SELECT conv_id, n_turns, n_copies, rendered FROM whole WHERE pre NOT IN (SELECT pre FROM p WHERE pos < n)
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))
    return found.select("doc_id", *(count(r.kind) for r in secrets.BASE), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("secrets")).alias("spans"))


def _op7_sql() -> str:
    """The same spans from the texts between matches, by RE2."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, '{pattern}') AS hits,
          regexp_extract_all(t, '{pattern}', {r.group}) AS checked, string_split_regex(t, '{pattern}') AS gaps, {r.least} AS least FROM d""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS ({" UNION ALL ".join(parts)}
), s AS (
  SELECT doc_id, rank, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS b,
         length(hits[i]) AS n, length(checked[i]) >= least AS ok
  FROM m, unnest(range(1, len(hits) + 1)) AS r(i)
), w AS (
  SELECT doc_id, rank, kind, CAST(b AS BIGINT) AS b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT) AS span FROM s WHERE ok
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
         string_agg(span, ',' ORDER BY b, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY b, rank) AS spans
  FROM w GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points found in five documents stay only in the one of largest id."""
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, from the mixture that explains it best."""
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


#: An item word list of at most 12 words is its only window.
OP2_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(s) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM win
), dg AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - k + 2)) AS r(s)
), occ AS (
  SELECT dg.doc_id, dg.s, dg.k, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(s, s + k)) AS r(p) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP8_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines
), confirmed AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT y.doc_id, y.line, y.pos, coalesce(c.keeper <> y.doc_id, false) AS gone FROM keyed y LEFT JOIN confirmed c ON y.k = c.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: All pairs through an inverted index: fit for small tables only.
OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON reach.other = e.a
), comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 2-word shingles reach a Jaccard similarity of 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_quality_rules": op5_quality_rules,
    "quality_ablations": quality_ablations,
    "op6_mix_sources": op6_mix_sources,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_minhash": op10_minhash,
}

SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_secret_scan": _op7_sql(),
    "op8_line_dedup": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_minhash": OP10_SQL,
}
