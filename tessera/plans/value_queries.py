"""Queries over values: transformers, schemas, text, binding, JSON, cost, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import transforms as tf
from tessera.operators import binding
from tessera.operators.pairing import infer_labels, pair_fields
from tessera.operators.typed import Field, Schema, apply_schema, is_ok
from tessera.plans import layouts, providers
from tessera.plans.cache import cache_key, split_by_cache
from tessera.plans.catalog import query
from tessera.plans.layout_queries import _BOUND, _FORM, fused_form
from tessera.plans.steps import TITLES
from tessera.sources.engines import html_blocks
from tessera.sources.staging import staged
from tessera.streaming.arrivals import step_rates

_S, _D = "CAST({} AS STRING)", "lpad(CAST({} AS STRING), 2, '0')"
_Y, _M, _DAY = "year(o_orderdate)", "month(o_orderdate)", "day(o_orderdate)"
_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "setiembre", "octubre", "noviembre", "Dic")
_MONTH_NAME = f"CASE {_M} " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(_MONTHS)) + " END"

#: Raw texts made of the order tables, the same in every engine.
RAW = {
    "dates": f"""CASE o_orderkey % 11 WHEN 0 THEN concat({_D.format(_DAY)}, '/', {_D.format(_M)}, '/', {_S.format(_Y)}) WHEN 1 THEN concat(' ', {_S.format(_DAY)}, '-', {_S.format(_M)}, '.', substr({_S.format(_Y)}, 3, 2), ' ')
      WHEN 2 THEN concat({_S.format(_DAY)}, ' de ', {_MONTH_NAME}, ' de ', {_S.format(_Y)}) WHEN 3 THEN concat({_S.format(_DAY)}, ' de ', {_MONTH_NAME}) WHEN 4 THEN concat('30/02/', {_S.format(_Y)}) WHEN 5 THEN concat({_S.format(_DAY)}, ' de Foo de ', {_S.format(_Y)})
      WHEN 6 THEN '  ' WHEN 7 THEN concat({_S.format(_Y)}, '-', {_D.format(_M)}, '-', {_D.format(_DAY)}) WHEN 8 THEN concat({_S.format(_Y)}, '-', {_D.format(_M)}, '-', {_D.format(_DAY)}, 'T10:', {_D.format('o_orderkey % 70')}, ':00Z') WHEN 9 THEN 'ayer' ELSE concat('31 ', {_MONTH_NAME}, ' del ', substr({_S.format(_Y)}, 3, 2)) END""",
    "amounts": """CASE o_orderkey % 13 WHEN 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',') WHEN 1 THEN concat(replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ','), ' €')
      WHEN 2 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) WHEN 3 THEN concat('1,', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), '.56 USD') WHEN 4 THEN 'not a number' WHEN 5 THEN '' WHEN 6 THEN CAST(o_custkey AS STRING)
      WHEN 7 THEN concat(CAST(o_custkey AS STRING), 'EUR') WHEN 8 THEN concat('1.', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), ',5 eur') WHEN 9 THEN concat('-', CAST(o_custkey AS STRING), ' %') WHEN 10 THEN '1.2.3,4,5' WHEN 11 THEN concat('12 345,', CAST(o_custkey % 100 AS STRING), ' £') ELSE '1_000' END""",
}
_NUM = "lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '0')"
_LETTER = f"substr('{tf.NIF_LETTERS}', CAST(((c_custkey * 7919) % 100000000) % 23 AS INT) + 1, 1)"
_NIE_NUM = "lpad(CAST((c_custkey * 7919) % 10000000 AS STRING), 7, '0')"
_NIE_LETTER = f"substr('{tf.NIF_LETTERS}', CAST(((c_custkey % 3) * 10000000 + (c_custkey * 7919) % 10000000) % 23 AS INT) + 1, 1)"
IDS = {
    "nif": f"CASE WHEN c_custkey % 7 = 0 THEN 'ABC' WHEN c_custkey % 11 = 0 THEN '' ELSE concat({_NUM}, CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE {_LETTER} END) END",
    "nie": f"CASE WHEN c_custkey % 7 = 0 THEN 'W1234567L' ELSE concat(substr('xYZ', CAST(c_custkey % 3 AS INT) + 1, 1), {_NIE_NUM}, CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE {_NIE_LETTER} END) END",
    "cif": "CASE WHEN c_custkey % 5 = 0 THEN lpad(CAST(c_custkey AS STRING), 9, '0') ELSE concat(substr('ABCDEFGH', CAST(c_custkey % 8 AS INT) + 1, 1), lpad(CAST((c_custkey * 7919) % 10000000 AS STRING), 7, '0'), CAST(c_custkey % 10 AS STRING)) END",
    "iban": "CASE WHEN c_custkey % 9 = 0 THEN 'ES12 ABC' WHEN c_custkey % 10 = 0 THEN 'es91 2100 0418 4502 0005 1332' ELSE concat('ES', lpad(CAST(c_custkey % 97 + 2 AS STRING), 2, '0'), lpad(CAST(c_custkey * 7919 AS STRING), 20, '0')) END",
    "bic": "CASE c_custkey % 4 WHEN 0 THEN 'bbva esmm' WHEN 1 THEN concat('BBVAESMM', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')) WHEN 2 THEN 'BAD' ELSE '' END",
    "phone": "CASE c_custkey % 6 WHEN 0 THEN concat('6', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 1 THEN concat('+34 ', '7', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 2 THEN concat('0034', '9', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 3 THEN '+1 (743) 555-3824' WHEN 4 THEN '12' ELSE ' ' END",
    "email": "CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_name, '@Example.com') WHEN 1 THEN concat('c', CAST(c_custkey AS STRING), '@example.com') WHEN 2 THEN 'a@b' ELSE '' END",
    "postal": "CASE WHEN c_custkey % 13 = 0 THEN '1234' WHEN c_custkey % 17 = 0 THEN '' ELSE lpad(CAST(c_custkey * 37 % 60000 AS STRING), 5, '0') END",
    "province": "CASE c_custkey % 5 WHEN 0 THEN 'MADRID' WHEN 1 THEN 'a coruña' WHEN 2 THEN ' Málaga ' WHEN 3 THEN 'Atlantis' ELSE '' END",
    "segment": "CASE WHEN c_custkey % 6 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END",
    "picks": "CASE c_custkey % 5 WHEN 0 THEN 'a, b' WHEN 1 THEN 'A,z' WHEN 2 THEN '' WHEN 3 THEN ',, b ,' ELSE 'c' END",
}


def _flat(raw: Column, transformer: tf.Transformer, **context: Column) -> list[Column]:
    t = transformer(raw, **context)
    value = t["normalized"]
    if transformer.kind == tf.MONEY_TYPE:
        said = [value["amount"].alias("amount"), value["currency"].alias("currency")]
    elif transformer.kind.startswith("array"):
        said = [F.array_join(value, ",").alias("value")]
    else:
        said = [value.alias("value")]
    return [*said, t["score"].alias("score"), F.array_join(t["issues"], ",").alias("issues")]


def _over(name: str, table: str, key: str, raw: str, transformer: tf.Transformer, sql: str, as_of: str | None = None) -> None:
    """Registers ``transformer`` over a raw expression; ``sql`` reads (k, r, t): key, raw and stripped text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = layouts.table(spark, sf_dir, table).selectExpr(f"{key} AS k", f"{raw} AS r")
        context = {"as_of": F.to_date(F.lit(as_of))} if as_of else {}
        return own.select("k", *_flat(F.col("r"), transformer, **context))

    query(f"WITH s AS (SELECT {key} AS k, {raw} AS r, trim({raw}) AS t FROM {table}) {sql}", name)(run)


def _cases(rows: list[tuple[str, str, str, str]], value: str = "VARCHAR", names: str = "value") -> str:
    """SELECT of the first case that holds: (condition, value, score, issue)."""
    pick = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rows) + " END"
    return f"k, CAST({pick(1)} AS {value}) AS {names}, CAST({pick(2)} AS DOUBLE) AS score, {pick(3)} AS issues"


# --- dates

_NUMERIC = r"'^\s*([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})\s*$'"
_LONG = r"'^\s*([0-9]{1,2})\s+(?:de\s+)?([A-Za-zÀ-ÿ]+)(?:\s+(?:de|del)\s+([0-9]{2,4}))?\s*$'"
_AS_OF = "2026-03-01"
_YEAR = "CASE WHEN {y} >= 100 THEN {y} WHEN {y} < 30 THEN {y} + 2000 ELSE {y} + 1900 END"
_MONTH_SQL = "CASE lower(regexp_extract(r, " + _LONG + ", 2, 'i')) " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in tf.MONTHS) + " END"
_PARSED = f"""p AS (SELECT *, regexp_matches(r, {_NUMERIC}) AS isn, regexp_matches(r, {_LONG}, 'i') AS isl,
  try_cast(regexp_extract(r, {_NUMERIC}, 1) AS INT) AS nd, try_cast(regexp_extract(r, {_NUMERIC}, 2) AS INT) AS nm, try_cast(regexp_extract(r, {_NUMERIC}, 3) AS INT) AS ny,
  try_cast(regexp_extract(r, {_LONG}, 1, 'i') AS INT) AS ld, {_MONTH_SQL} AS lm, try_cast(nullif(regexp_extract(r, {_LONG}, 3, 'i'), '') AS INT) AS ly FROM s),
 q AS (SELECT *, try_cast(lpad(CAST({_YEAR.format(y='ny')} AS VARCHAR), 4, '0') || '-' || lpad(CAST(nm AS VARCHAR), 2, '0') || '-' || lpad(CAST(nd AS VARCHAR), 2, '0') AS DATE) AS ndate,
  try_cast(lpad(CAST(coalesce({_YEAR.format(y='ly')}, 2026) AS VARCHAR), 4, '0') || '-' || lpad(CAST(lm AS VARCHAR), 2, '0') || '-' || lpad(CAST(ld AS VARCHAR), 2, '0') AS DATE) AS ldate FROM p)"""
_EMPTY, _ELSE = ("t = ''", "NULL", "0.0", "'empty'"), ("true", "NULL", "0.0", "'format_unrecognized'")
_N = [("isn AND ndate IS NOT NULL", "ndate", "1.0", "''"), ("isn", "NULL", "0.0", "'invalid_date'")]
_LC = [("isl AND lm IS NULL", "NULL", "0.0", "'unknown_month'"), ("isl AND ldate IS NULL", "NULL", "0.0", "'invalid_date'"), ("isl AND ly IS NULL", "ldate", "0.7", "'year_inferred'"), ("isl", "ldate", "1.0", "''")]
for _name, _t, _rows in (("tf_date_es", tf.date_es, [*_N, *_LC]), ("tf_date_es_short", tf.date_es_short, _N), ("tf_date_es_long", tf.date_es_long, _LC)):
    _over(_name, "orders", "o_orderkey", RAW["dates"], _t, f", {_PARSED} SELECT {_cases([_EMPTY, *_rows, _ELSE], 'DATE')} FROM q", _AS_OF)
_ISO_OK = "regexp_matches(r, '^\\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\\s*$')"
_over("tf_date_iso", "orders", "o_orderkey", RAW["dates"], tf.date_iso, f"SELECT {_cases([_EMPTY, (f'{_ISO_OK} AND try_cast(t AS DATE) IS NOT NULL', 'try_cast(t AS DATE)', '1.0', chr(39) * 2), (_ISO_OK, 'NULL', '0.0', chr(39) + 'invalid_date' + chr(39)), _ELSE], 'DATE')} FROM s", _AS_OF)
_DT = "regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?([.][0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$')"
_over("tf_datetime_iso", "orders", "o_orderkey", RAW["dates"], tf.datetime_iso, f"SELECT {_cases([_EMPTY, (f'{_DT} AND try_cast(substr(t, 1, 19) AS TIMESTAMP) IS NOT NULL', 'try_cast(substr(t, 1, 19) AS TIMESTAMP)', '1.0', chr(39) * 2), (_DT, 'NULL', '0.0', chr(39) + 'invalid_datetime' + chr(39)), (f'{_ISO_OK}', 'try_cast(t AS TIMESTAMP)', '1.0', chr(39) * 2), ('true', 'NULL', '0.0', chr(39) + 'invalid_datetime' + chr(39))], 'TIMESTAMP')} FROM s")

# --- amounts

_CODE = r"'(?i)\b(EUR|USD|GBP|JPY|CHF|CAD|AUD)\b'"
_MONEY = rf"""m AS (SELECT *, CASE WHEN contains(t, '€') THEN 'EUR' WHEN contains(t, '$') THEN 'USD' WHEN contains(t, '£') THEN 'GBP' WHEN contains(t, '¥') THEN 'JPY' END AS sign,
  CASE WHEN contains(t, '€') THEN replace(t, '€', '') WHEN contains(t, '$') THEN replace(t, '$', '') WHEN contains(t, '£') THEN replace(t, '£', '') WHEN contains(t, '¥') THEN replace(t, '¥', '') ELSE t END AS b0 FROM s),
 n AS (SELECT *, coalesce(upper(nullif(regexp_extract(b0, {_CODE}, 1), '')), sign) AS cur, trim(regexp_replace(b0, {_CODE}, '', 'g')) AS b FROM m),
 o AS (SELECT *, replace(replace(replace(b, ' ', ''), '.', ''), ',', '.') AS eu, replace(replace(b, ' ', ''), ',', '') AS us, replace(b, ' ', '') AS pl,
  CASE WHEN contains(b, ',') THEN length(b) - instr(reverse(b), ',') ELSE -1 END AS lc, CASE WHEN contains(b, '.') THEN length(b) - instr(reverse(b), '.') ELSE -1 END AS ld FROM n)"""
_NUM_OK = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def _num(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, {_NUM_OK}) THEN try_cast({x} AS DECIMAL(38,9)) END)"


_AUTO = f"CASE WHEN lc > ld THEN {_num('eu')} WHEN ld > lc THEN {_num('us')} ELSE {_num('pl')} END"


def _money_sql(value: str, forced: str | None) -> str:
    cur = f"'{forced}'" if forced else "cur"
    return f""", {_MONEY}, z AS (SELECT *, {value} AS v FROM o) SELECT k, CASE WHEN t <> '' THEN v END AS amount, CASE WHEN t <> '' AND v IS NOT NULL THEN {cur} END AS currency,
     CAST(CASE WHEN t = '' OR v IS NULL THEN 0.0 WHEN {cur} IS NULL THEN 0.7 ELSE 1.0 END AS DOUBLE) AS score, CASE WHEN t = '' THEN 'empty' WHEN v IS NULL THEN 'amount_unparseable' WHEN {cur} IS NULL THEN 'currency_ambiguous' ELSE '' END AS issues FROM z"""


for _name, _t, _value, _forced in (
    ("tf_amount_eu", tf.amount_eu, _num("eu"), None), ("tf_amount_us", tf.amount_us, _num("us"), None), ("tf_amount_eur", tf.amount_eur, _num("eu"), "EUR"), ("tf_amount_usd", tf.amount_usd, _num("us"), "USD"),
    ("tf_amount_currency", tf.amount_currency("GBP"), f"coalesce({_num('us')}, {_num('eu')})", "GBP"), ("tf_amount_auto", tf.amount_auto, _AUTO, None),
):
    _over(_name, "orders", "o_orderkey", RAW["amounts"], _t, _money_sql(_value, _forced))

_DEC = """d AS (SELECT *, {body} AS b FROM s), e AS (SELECT *, CASE WHEN contains(b, ',') THEN length(b) - instr(reverse(b), ',') ELSE -1 END AS lc, CASE WHEN contains(b, '.') THEN length(b) - instr(reverse(b), '.') ELSE -1 END AS ld FROM d),
 f AS (SELECT *, CASE WHEN lc > ld THEN replace(replace(b, '.', ''), ',', '.') WHEN ld > lc THEN replace(b, ',', '') ELSE b END AS c FROM e)"""
for _name, _t, _body in (("tf_decimal", tf.decimal, "replace(t, ' ', '')"), ("tf_percentage", tf.percentage, "replace(replace(t, '%', ''), ' ', '')")):
    _issue = f"'{_t.name}_format_invalid'"
    _over(_name, "orders", "o_orderkey", RAW["amounts"], _t, f", {_DEC.format(body=_body)} SELECT {_cases([_EMPTY, (_num('c') + ' IS NOT NULL', _num('c'), '1.0', chr(39) * 2), ('true', 'NULL', '0.0', _issue)], 'DECIMAL(38,9)')} FROM f")
_INT = "replace(replace(replace(t, ' ', ''), '.', ''), ',', '')"
_over("tf_integer", "orders", "o_orderkey", RAW["amounts"], tf.integer, f"SELECT {_cases([_EMPTY, (f'regexp_matches({_INT}, {chr(39)}^-?[0-9]+${chr(39)})', f'try_cast({_INT} AS BIGINT)', '1.0', chr(39) * 2), ('true', 'NULL', '0.0', chr(39) + 'integer_format_invalid' + chr(39))], 'BIGINT')} FROM s")

# --- identifiers


def _id(name: str, source: str, transformer: tf.Transformer, clean: str, rows: list[tuple[str, str, str, str]], value: str = "VARCHAR") -> None:
    _over(name, "customer", "c_custkey", IDS[source], transformer, f", c AS (SELECT k, r, {clean} AS t FROM s) SELECT {_cases([_EMPTY, *rows], value)} FROM c")


_IDC, _BANK, _PH = r"regexp_replace(upper(r), '[\s\-./]', '', 'g')", r"regexp_replace(upper(r), '\s+', '', 'g')", r"regexp_replace(r, '[\s\-().]', '', 'g')"
_LET = f"substr('{tf.NIF_LETTERS}', CAST({{n}} AS INT) % 23 + 1, 1) = substr(t, 9, 1)"


def _q(text: str) -> str:
    return f"'{text}'"


_id("tf_nif", "nif", tf.nif_es, _IDC, [("NOT regexp_matches(t, '^[0-9]{8}[A-Z]$')", "NULL", "0.0", _q("nif_format_invalid")), (_LET.format(n="substr(t, 1, 8)"), "t", "1.0", "''"), ("true", "t", "0.5", _q("nif_checksum_mismatch"))])
_id("tf_nie", "nie", tf.nie_es, _IDC, [("NOT regexp_matches(t, '^[XYZ][0-9]{7}[A-Z]$')", "NULL", "0.0", _q("nie_format_invalid")), (_LET.format(n="translate(substr(t, 1, 8), 'XYZ', '012')"), "t", "1.0", "''"), ("true", "t", "0.5", _q("nie_checksum_mismatch"))])
_id("tf_cif", "cif", tf.cif_es, _IDC, [("regexp_matches(t, '^[ABCDEFGHJKLMNPQRSUVW][0-9]{7}[0-9A-J]$')", "t", "0.8", "''"), ("true", "NULL", "0.0", _q("cif_format_invalid"))])
_DIGITS = "translate(regexp_replace(regexp_replace(substr(t, 5) || substr(t, 1, 4), 'E', '14', 'g'), 'S', '28', 'g'), '', '')"
_id("tf_iban", "iban", tf.iban, _BANK, [("NOT regexp_matches(t, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$')", "NULL", "0.0", _q("iban_format_invalid")), (f"CAST({_DIGITS} AS HUGEINT) % 97 = 1", "t", "1.0", "''"), ("true", "t", "0.5", _q("iban_checksum_mismatch"))])
_id("tf_bic", "bic", tf.bic, _BANK, [("regexp_matches(t, '^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$')", "t", "0.9", "''"), ("true", "NULL", "0.0", _q("bic_format_invalid"))])
_id("tf_phone_es", "phone", tf.phone_es, _PH, [(r"regexp_matches(t, '^(\+34|0034)?[6789][0-9]{8}$')", "'+34' || right(t, 9)", "1.0", "''"), ("true", "t", "0.0", _q("phone_format_invalid"))])
_id("tf_phone_intl", "phone", tf.phone_international, _PH, [("NOT starts_with(t, '+')", "t", "0.0", _q("missing_country_code")), ("true", "t", "0.7", "''")])
_id("tf_email", "email", tf.email, "lower(trim(r))", [(r"regexp_matches(t, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$')", "t", "1.0", "''"), ("true", "NULL", "0.0", _q("email_format_invalid"))])
_id("tf_postal", "postal", tf.postal_code_es, "trim(r)", [("NOT regexp_matches(t, '^[0-9]{5}$')", "NULL", "0.0", _q("postal_code_invalid")), ("CAST(substr(t, 1, 2) AS INT) BETWEEN 1 AND 52", "t", "1.0", "''"), ("true", "t", "0.5", _q("postal_code_prefix_unknown"))])
_id("tf_province", "province", tf.province_es, "trim(r)", [("lower(t) = 'madrid'", _q("Madrid"), "1.0", "''"), ("lower(t) = 'a coruña'", _q("A Coruña"), "1.0", "''"), ("lower(t) = 'málaga'", _q("Málaga"), "1.0", "''"), ("true", "t", "0.5", _q("province_unknown"))])
_id("tf_regex", "segment", tf.regex("[A-Z]+"), "trim(r)", [("regexp_matches(t, '^[A-Z]+$')", "t", "1.0", "''"), ("true", "NULL", "0.0", _q("regex_no_match"))])
_id("tf_enum", "segment", tf.enum(("Household", "Machinery")), "trim(r)", [("lower(t) = 'household'", _q("Household"), "1.0", "''"), ("lower(t) = 'machinery'", _q("Machinery"), "1.0", "''"), ("true", "NULL", "0.0", _q("not_in_enum"))])
_id("tf_compose", "postal", tf.compose(tf.postal_code_es, tf.integer), "trim(r)", [("NOT regexp_matches(t, '^[0-9]{5}$')", "NULL", "0.0", _q("postal_code_invalid")), ("CAST(substr(t, 1, 2) AS INT) BETWEEN 1 AND 52", "CAST(t AS BIGINT)", "1.0", "''"), ("true", "CAST(t AS BIGINT)", "0.5", _q("postal_code_prefix_unknown"))], "BIGINT")
_id("tf_checkbox_choice", "segment", tf.checkbox_choice(("Household", "Building")), "trim(r)", [("lower(t) = 'household'", _q("Household"), "0.9", "''"), ("lower(t) = 'building'", _q("Building"), "0.9", "''"), ("true", "NULL", "0.0", _q("not_in_choices"))])
_id("tf_checkbox_binary", "segment", tf.checkbox_binary("household", "building"), "trim(r)", [("lower(t) = 'household'", "true", "1.0", "''"), ("lower(t) = 'building'", "false", "1.0", "''"), ("true", "NULL", "0.0", _q("not_binary_label"))], "BOOLEAN")


@query(f"""WITH s AS (SELECT c_custkey AS k, {IDS['picks']} AS r FROM customer), p AS (SELECT k, r, list_filter(list_transform(string_split(r, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS ps FROM s)
 SELECT k, array_to_string(list_filter(ps, lambda x: x IN ('a', 'b')), ',') AS value, CAST(CASE WHEN trim(r) = '' THEN 0.0 WHEN len(list_filter(ps, lambda x: x NOT IN ('a', 'b'))) > 0 THEN 0.6 ELSE 1.0 END AS DOUBLE) AS score,
  CASE WHEN trim(r) = '' THEN 'empty' WHEN len(list_filter(ps, lambda x: x NOT IN ('a', 'b'))) > 0 THEN 'unknown_choice' ELSE '' END AS issues FROM p""")
def tf_checkbox_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{IDS['picks']} AS r")
    return own.select("k", *_flat(F.col("r"), tf.multi_checkbox(("a", "b"))))


_URL = "CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') WHEN page_id % 7 = 0 THEN '' WHEN page_id % 11 = 0 THEN 'http:///x' ELSE url END"
_over("tf_url", "pages", "page_id", _URL, tf.url, f"SELECT {_cases([_EMPTY, ('regexp_matches(CASE WHEN contains(t, ' + _q('://') + ') THEN t ELSE ' + _q('https://') + ' || t END, ' + _q('^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]') + ')', 'CASE WHEN contains(t, ' + _q('://') + ') THEN t ELSE ' + _q('https://') + ' || t END', '1.0', chr(39) * 2), ('true', 'NULL', '0.0', _q('url_invalid'))])} FROM s")

# --- schemas

SCHEMA = Schema({
    "pedido.fecha": Field(tf.date_es, True, None, ("Fecha",)), "pedido.importe": Field(tf.amount_eu, True, "Importe total", ("Importe",)), "cliente": Field(tf.regex("Customer#[0-9]+")),
    "estado": Field(tf.checkbox_choice(("F", "O", "P")), False, None, ("Estado",)), "pedido.numero": Field(tf.integer, True, None, ("Número",)),
})


def typed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = layouts.form_rects(spark, sf_dir)
    bound = pair_fields(fused_form(spark, sf_dir), boxes, SCHEMA.specs())
    docs = layouts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return apply_schema(docs, staged(bound, "bound"), SCHEMA, boxes, F.to_date(F.lit(_AS_OF)))


_TYPED = f"""{_FORM}, {_BOUND}, v AS (SELECT doc_id, field_name AS field, value AS raw,
  CASE field_pos WHEN 0 THEN CAST(strptime(value, '%d/%m/%Y')::DATE AS VARCHAR) WHEN 1 THEN CAST(CAST(replace(replace(value, ' €', ''), ',', '.') AS DECIMAL(38,9)) AS VARCHAR) || CASE WHEN contains(value, '€') THEN ' EUR' ELSE '' END ELSE value END AS normalized_str,
  CAST(CASE WHEN field_pos = 1 AND NOT contains(value, '€') THEN 0.7 WHEN field_pos = 3 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence, CASE WHEN field_pos = 1 AND NOT contains(value, '€') THEN 'currency_ambiguous' ELSE '' END AS issues FROM bound)
 SELECT * FROM v UNION ALL SELECT doc_id, f.n, '', NULL, 0.0, 'required_field_missing' FROM (SELECT DISTINCT doc_id FROM form) d, (VALUES ('pedido.importe'), ('pedido.numero')) AS f(n) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = d.doc_id AND v.field = f.n)"""


@query(_TYPED)
def schema_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_form(spark, sf_dir).select("doc_id", "field", "raw", "normalized_str", "confidence", F.array_join("issues", ",").alias("issues"))


@query(f"WITH typed AS ({_TYPED}) SELECT field, count(*) AS n, count(*) FILTER (WHERE issues = '' AND normalized_str IS NOT NULL) AS n_ok FROM typed GROUP BY field")
def typed_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_form(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), F.count_if(is_ok()).alias("n_ok"))


_LAID = "SELECT o_orderkey AS doc_id, o_orderstatus AS value, CASE WHEN o_orderkey % 4 = 0 THEN 400 ELSE 170 END AS vx FROM orders"


@query(f"""WITH v AS ({_LAID}) SELECT doc_id, 'estado' AS field, value AS raw, CASE WHEN value IN ('F', 'O') THEN value END AS normalized_str,
  CAST(CASE WHEN value NOT IN ('F', 'O') THEN 0.0 WHEN vx = 400 THEN 0.9 WHEN value = 'F' THEN 1.0 ELSE 0.7 END AS DOUBLE) AS confidence, CASE WHEN value NOT IN ('F', 'O') THEN 'not_in_choices' WHEN vx < 400 AND value <> 'F' THEN 'no_filled_checkbox_nearby' ELSE '' END AS issues FROM v""")
def typed_checkboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values laid over the first checkbox of the form, which is filled for F, or (every fourth) away from all."""
    layouts.table(spark, sf_dir, "orders").createOrReplaceTempView("laid_orders")
    bound = spark.sql(_LAID.replace("FROM orders", "FROM laid_orders")).selectExpr("doc_id", "0 AS field_pos", "'estado' AS field_name", "value", "array(1) AS source_items", "CAST(vx AS DOUBLE) AS x", "215D AS y", "30D AS w", "20D AS h", "1 AS page", "1D AS match_score")
    schema = Schema({"estado": Field(tf.checkbox_choice(("F", "O")))})
    typed = apply_schema(bound, bound, schema, layouts.form_rects(spark, sf_dir))
    return typed.select("doc_id", "field", "raw", "normalized_str", "confidence", F.array_join("issues", ",").alias("issues"))


_KEYS = (("titular.nif", "Nif"), ("fecha_de_nacimiento", "Fecha de de nacimiento|Fecha de nacimiento"), ("a.b.codigo_postal", "Codigo de postal|Codigo postal"), ("x.", ""), ("IMPORTE_total_neto", "Importe de total neto|Importe total neto"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _KEYS) + ") AS t(field, labels)")
def label_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, "|".join(infer_labels(k))) for k, _ in _KEYS], "field string, labels string")


# --- text

_LINES = "lines AS (SELECT doc_id, CAST(pos - 1 AS INT) AS item_idx, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))"


@query(f"WITH {_LINES} SELECT doc_id, item_idx, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS norm FROM lines")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.prose(spark, sf_dir).select("doc_id", "item_idx", tx.normalize(F.col("text")).alias("norm"))


@query(f"WITH {_LINES} SELECT doc_id, item_idx, trim(regexp_replace(lower(strip_accents(rtrim(trim(line), ':'))), '\\s+', ' ', 'g')) AS norm FROM lines")
def label_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.prose(spark, sf_dir).select("doc_id", "item_idx", tx.normalize_label(F.col("text")).alias("norm"))


_FONT = "CASE o_custkey % 6 WHEN 0 THEN 'Arial-BoldMT' WHEN 1 THEN 'HELVETICA-Black' WHEN 2 THEN 'Times-Italic' WHEN 3 THEN 'Courier-HeavyOblique' WHEN 4 THEN NULL ELSE 'Helvetica' END"


@query(f"SELECT o_orderkey AS doc_id, coalesce(regexp_matches(lower({_FONT}), 'bold|black|heavy'), false) AS bold, coalesce(regexp_matches(lower({_FONT}), 'italic|oblique'), false) AS slanted FROM orders")
def font_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_FONT} AS font")
    return own.select("doc_id", tx.is_bold(F.col("font")).alias("bold"), tx.is_italic(F.col("font")).alias("slanted"))


_LABEL_RAW = "CASE c_custkey % 5 WHEN 0 THEN concat(c_name, ':') WHEN 1 THEN concat(c_name, ': ') WHEN 2 THEN concat(c_name, '：') WHEN 3 THEN ':' ELSE c_name END"


@query(f"SELECT c_custkey AS k, ends_with(trim({_LABEL_RAW}), ':') OR ends_with(trim({_LABEL_RAW}), '：') AS is_label, trim(rtrim({_LABEL_RAW}, ':：')) AS key FROM customer")
def label_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", f"{_LABEL_RAW} AS r")
    return own.select("k", tx.is_label(F.col("r")).alias("is_label"), tx.strip_label(F.col("r")).alias("key"))


# --- binding


_NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_HAY = f"{_LINES}, norms AS (SELECT doc_id, item_idx, {_NORM.format('line')} AS norm FROM lines), placed AS (SELECT *, coalesce(sum(length(norm) + 1) OVER (PARTITION BY doc_id ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM norms WHERE norm <> ''), hay AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY item_idx) AS hay FROM placed GROUP BY doc_id)"
_NEED = "need AS (SELECT doc_id, CAST(item_id AS INT) AS field_pos, {} AS value FROM documents d, benchmark b)"
_TIERS = f"""t AS (SELECT n.*, coalesce(hay, '') AS hay, {_NORM.format('value')} AS needle, regexp_replace({_NORM.format('value')}, '[^\\p{{L}}\\p{{N}}_\\s%]', '', 'g') AS soft FROM need n LEFT JOIN hay USING (doc_id)),
 m AS (SELECT *, CASE WHEN needle <> '' AND needle = hay THEN 1.0 WHEN needle <> '' AND contains(hay, needle) THEN 0.95 WHEN soft <> '' AND soft <> needle AND contains(hay, soft) THEN 0.9 ELSE 0.0 END AS match_score FROM t),
 f AS (SELECT *, CASE WHEN match_score >= 0.95 THEN instr(hay, needle) - 1 WHEN match_score > 0 THEN instr(hay, soft) - 1 END AS start, CASE WHEN match_score >= 0.95 THEN length(needle) WHEN match_score > 0 THEN length(soft) END AS size FROM m)"""
_METHOD = "CASE WHEN match_score = 1 THEN 'exact' WHEN match_score > 0 THEN 'substring' ELSE 'not_found' END AS match_method, CAST(match_score AS DOUBLE) AS match_score"


def _everywhere(spark: SparkSession, sf_dir: str, values: DataFrame, fuzzy_threshold: float | None) -> DataFrame:
    """Values (field_pos, value) in every document."""
    named = values.select("field_pos", F.concat(F.lit("item_"), F.col("field_pos").cast("string")).alias("field_name"), "value")
    return binding.search_values(named, layouts.table(spark, sf_dir, "documents"), binding.haystacks(layouts.prose(spark, sf_dir)), fuzzy_threshold)


def _passages(spark: SparkSession, sf_dir: str, value: str = "text") -> DataFrame:
    """Every benchmark passage, whole."""
    return layouts.table(spark, sf_dir, "benchmark").selectExpr("CAST(item_id AS INT) AS field_pos", f"{value} AS value")


def _tiers(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "field_pos", "match_method", "match_score", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))


@query(f"WITH {_HAY}, {_NEED.format("b.text")}, {_TIERS} SELECT doc_id, field_pos, {_METHOD}, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size FROM f")
def bind_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage in every document, without the fuzzy tier."""
    return _tiers(_everywhere(spark, sf_dir, _passages(spark, sf_dir), None))


_SOFT = "concat('¡', replace({}, ' ', '! '), '?')"
_SENTENCES = f"""need AS (SELECT doc_id, CAST(item_id * 1000 + pos AS INT) AS field_pos, {_SOFT.format('s')} AS value FROM documents d,
 (SELECT item_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM benchmark) AS b)"""


@query(f"WITH {_HAY}, {_SENTENCES}, {_TIERS} SELECT doc_id, field_pos, {_METHOD}, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size FROM f")
def bind_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every passage, with marks put between its words, in every document."""
    sentences = layouts.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "s"))
    return _tiers(_everywhere(spark, sf_dir, sentences.selectExpr("CAST(item_id * 1000 + pos AS INT) AS field_pos", f"{_SOFT.format('s')} AS value"), None))


@query(f"WITH {_HAY}, need AS (SELECT doc_id, 0 AS field_pos, '  ' || text || chr(9) AS value FROM documents), {_TIERS} SELECT doc_id, field_pos, {_METHOD} FROM f")
def bind_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = layouts.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("field_pos"), F.lit("all").alias("field_name"), F.concat(F.lit("  "), "text", F.lit("\t")).alias("value"))
    return binding.match_values(docs, binding.haystacks(layouts.prose(spark, sf_dir)), None).select("doc_id", "field_pos", "match_method", "match_score")


def _fused_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("item_idx") == 0, "title").when(F.col("item_idx") % 7 == 3, "page_header").otherwise("text")
    return layouts.prose(spark, sf_dir).withColumns({"section_title": F.when(F.col("item_idx") % 3 == 1, F.lit("S")), "block_label": label})


_PROSE = """pi AS (SELECT doc_id, item_idx, CAST(floor(item_idx / 40.0) AS INT) + 1 AS page, CAST(50 AS DOUBLE) AS x, CAST(40 + (item_idx % 40) * 18 AS DOUBLE) AS y, CAST(6 * length(line) AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h, CASE WHEN item_idx % 3 = 1 THEN 'S' END AS section_title,
  CASE WHEN item_idx = 0 THEN 'title' WHEN item_idx % 7 = 3 THEN 'page_header' ELSE 'text' END AS block_label FROM lines)"""
_SOURCES = f"""sp AS (SELECT f.doc_id, field_pos, pi.* EXCLUDE (doc_id) FROM f JOIN placed p ON p.doc_id = f.doc_id AND p.st < f.start + f.size AND p.st + length(p.norm) > f.start JOIN pi ON pi.doc_id = p.doc_id AND pi.item_idx = p.item_idx),
 u AS (SELECT doc_id, field_pos, string_agg(CAST(item_idx AS VARCHAR), ',' ORDER BY item_idx) AS source_items, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, arg_min(page, item_idx) AS page, arg_min(section_title, item_idx) FILTER (WHERE section_title <> '') AS section_title FROM sp GROUP BY ALL),
 lb AS (SELECT sp.doc_id, sp.field_pos, block_label, row_number() OVER (PARTITION BY sp.doc_id, sp.field_pos ORDER BY pow(sp.x + sp.w / 2 - (u.x + u.w / 2), 2) + pow(sp.y + sp.h / 2 - (u.y + u.h / 2), 2), item_idx) AS k FROM sp JOIN u USING (doc_id, field_pos)),
 bound AS (SELECT f.doc_id, f.field_pos, {_METHOD}, source_items, u.x, u.y, u.w, u.h, page, section_title, block_label FROM f LEFT JOIN u USING (doc_id, field_pos) LEFT JOIN lb ON lb.doc_id = f.doc_id AND lb.field_pos = f.field_pos AND k = 1)"""


def _bound(spark: SparkSession, sf_dir: str, fuzzy_threshold: float | None) -> DataFrame:
    """Every passage bound in every document."""
    return binding.bind_found(staged(_everywhere(spark, sf_dir, _passages(spark, sf_dir), fuzzy_threshold), "found"), _fused_prose(spark, sf_dir))


def _sources(bound: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("source_items", lambda i: i.cast("string")), ",")
    return bound.select("doc_id", "field_pos", "match_method", "match_score", said.alias("source_items"), "x", "y", "w", "h", "page", "section_title", "block_label")


@query()
def bind_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own threshold, so that an altered copy is found and has sources."""
    return _sources(_bound(spark, sf_dir, binding.FUZZY_FROM))


@query(f"WITH {_HAY}, {_NEED.format('b.text')}, {_TIERS}, {_PROSE}, {_SOURCES} SELECT doc_id, field_pos, match_method, match_score, coalesce(source_items, '') AS source_items, x, y, w, h, page, section_title, block_label FROM bound")
def bind_sources_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the fuzzy tier, which SQL can't follow."""
    return _sources(_bound(spark, sf_dir, None))


@query()
def bind_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with one letter replaced, in every document."""
    value = "concat(substr(text, 1, 12), CASE WHEN substr(text, 13, 1) = 'q' THEN 'z' ELSE 'q' END, substr(text, 14))"
    return _everywhere(spark, sf_dir, _passages(spark, sf_dir, value), binding.FUZZY_FROM).select("doc_id", "field_pos", "match_method", "match_score")


#: A needle of seven letters with one replaced, and a text of a few dozen: short enough for the subsequences to be spelled out in SQL.
_SHORT_NEEDLE, _SHORT_TEXT = "concat(substr(s_name, 1, 3), CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE substr(s_name, 4, 1) END, substr(s_name, 5, 3))", "concat(CAST(s_suppkey AS STRING), ' ', CASE WHEN s_suppkey % 5 = 0 THEN 'suplier' ELSE 'the Supplier' END, ' of ', CAST(s_nationkey AS STRING))"


@query(f"""WITH p AS (SELECT s_suppkey AS doc_id, lower({_SHORT_NEEDLE}) AS n, lower({_SHORT_TEXT}) AS h FROM supplier),
 w AS (SELECT doc_id, n, h, i, substr(h, greatest(i, 0) + 1, least(i + 7, length(h)) - greatest(i, 0)) AS win FROM p, unnest(range(-6, length(h))) AS r(i)),
 u AS (SELECT DISTINCT n, win FROM w),
 g AS (SELECT n, win, list_reduce(list_prepend([0, 0, 0, 0, 0, 0, 0, 0], list_transform(range(1, length(win) + 1), lambda k: [k])),
  lambda a, c: list_transform(range(1, 9), lambda j: list_max(list_transform(range(1, j + 1), lambda q: CASE WHEN q = 1 THEN a[1] WHEN substr(n, q - 1, 1) = substr(win, c[1], 1) THEN greatest(a[q], a[q - 1] + 1) ELSE a[q] END))))[8] AS lcs FROM u),
 r AS (SELECT w.*, 200.0 * lcs / (7 + length(win)) AS ratio FROM w JOIN g USING (n, win)),
 b AS (SELECT doc_id, any_value(n) AS n, any_value(h) AS h, max(ratio) AS best, coalesce(min(i) FILTER (WHERE i >= 0 AND length(win) = 7 AND ratio >= 97), arg_min(i, ROW(-ratio, i)) FILTER (WHERE i >= 0 AND length(win) = 7)) AS start FROM r GROUP BY doc_id)
 SELECT doc_id, CASE WHEN contains(h, n) THEN 'substring' WHEN best >= 85 THEN 'fuzzy' ELSE 'not_found' END AS match_method, CASE WHEN contains(h, n) THEN 0.95 WHEN best >= 85 THEN round(best / 100, 3) ELSE 0.0 END AS match_score,
  CAST(CASE WHEN contains(h, n) THEN instr(h, n) - 1 WHEN best >= 85 THEN start END AS BIGINT) AS start FROM b""")
def bind_fuzzy_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's name, often misspelled, in its own short text."""
    own = layouts.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc_id", "0 AS field_pos", "'name' AS field_name", f"{_SHORT_NEEDLE} AS value", "0 AS item_idx", f"{_SHORT_TEXT} AS text")
    found = binding.match_values(own.select("doc_id", "field_pos", "field_name", "value"), binding.haystacks(own.select("doc_id", "item_idx", "text")))
    return found.select("doc_id", "match_method", "match_score", F.col("start").cast("long").alias("start"))


_ISSUES = f"""WITH {_HAY}, {_NEED.format('b.text')}, {_TIERS}, {_PROSE}, {_SOURCES}, issues AS (
 SELECT doc_id, field_pos, 'hallucination' AS issue_type, 'high' AS severity FROM bound WHERE match_method = 'not_found'
 UNION ALL SELECT doc_id, field_pos, 'low_confidence', 'medium' FROM bound WHERE match_method <> 'not_found' AND match_score < 0.97
 UNION ALL SELECT doc_id, field_pos, 'role_mismatch', 'medium' FROM bound WHERE match_method <> 'not_found' AND block_label IN ('section_header', 'title', 'page_header', 'page_footer', 'picture'))"""


@query()
def issues_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own threshold: an altered copy is weakly found, not invented."""
    return binding.collect_issues(_bound(spark, sf_dir, binding.FUZZY_FROM), "flag", 0.97).select("doc_id", "field_pos", "issue_type", "severity")


@query(f"{_ISSUES} SELECT * FROM issues")
def issues_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the fuzzy tier; 0.97 asks for more than the score of a part of a text, so every passage found inside one is of low confidence."""
    return binding.collect_issues(_bound(spark, sf_dir, None), "flag", 0.97).select("doc_id", "field_pos", "issue_type", "severity")


@query(f"{_ISSUES} SELECT doc_id, field_pos, issue_type, severity FROM issues WHERE issue_type <> 'hallucination'")
def issues_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy ``drop``: what was not found has no issue left."""
    return binding.collect_issues(_bound(spark, sf_dir, None), "drop", 0.97).select("doc_id", "field_pos", "issue_type", "severity")


@query(f"{_ISSUES} SELECT doc_id, string_agg(DISTINCT issue_type, ',' ORDER BY issue_type) AS issue_types FROM issues GROUP BY doc_id")
def issues_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = binding.collect_issues(_bound(spark, sf_dir, None), "flag", 0.97)
    return binding.issue_types(issues).select("doc_id", F.array_join("issue_types", ",").alias("issue_types"))


# --- JSON

_JSON = """concat('{"a":{"type":"', event_type, '","n":', CAST(user_id AS STRING), '},"l":["x",null,', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '""' END, '],"p":', props, '}')"""


@query("""WITH e AS (SELECT event_id AS doc_id, event_type, user_id, CAST(props::JSON->>'k' AS VARCHAR) AS kv FROM events)
 SELECT doc_id, 'a.type' AS field_name, event_type AS value FROM e UNION ALL SELECT doc_id, 'a.n', CAST(user_id AS VARCHAR) FROM e UNION ALL SELECT doc_id, 'l[0]', 'x' FROM e
 UNION ALL SELECT doc_id, 'l[2]', 'true' FROM e WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'p.k', kv FROM e WHERE kv IS NOT NULL""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = layouts.table(spark, sf_dir, "events").selectExpr("event_id AS doc_id", f"{_JSON} AS json")
    return binding.walk_json(docs, "json").select("doc_id", "field_name", "value")


_ANSWER = """CASE event_id % 5 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN props WHEN 2 THEN concat('Here: ', props, ' done') WHEN 3 THEN 'no json' ELSE '[1, 2]' END"""


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 5 < 3 THEN CAST(props::JSON->>'k' AS VARCHAR) END AS k FROM events")
def json_parse_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.table(spark, sf_dir, "events").selectExpr("event_id AS doc_id", f"{_ANSWER} AS answer")
    return own.select("doc_id", F.try_variant_get(tx.parse_json_object(F.col("answer")), "$.k", "string").alias("k"))


# --- cost, cache, sources

_MODEL = "CASE conv_id % 4 WHEN 0 THEN 'gpt-5-mini' WHEN 1 THEN 'gemini-2.5-flash' WHEN 2 THEN 'claude-haiku-4.5' ELSE 'unknown' END"
_IN, _OUT = "CASE WHEN role = 'user' THEN length(text) ELSE 0 END", "CASE WHEN role = 'user' THEN 0 ELSE length(text) END"
_PRICED = f"WITH c AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS call_idx, {_MODEL} AS model_used, CAST({_IN} AS BIGINT) AS tokens_in, CAST({_OUT} AS BIGINT) AS tokens_out FROM conversations), p AS (SELECT *, coalesce(round((tokens_in * i + tokens_out * o) / 1000000, 8), 0.0) AS usd FROM c LEFT JOIN (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, i, o in providers.PRICES) + ") AS r(m, i, o) ON m = model_used)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "CAST(turn AS INT) AS call_idx", f"{_MODEL} AS model_used", f"CAST({_IN} AS BIGINT) AS tokens_in", f"CAST({_OUT} AS BIGINT) AS tokens_out")
    return own.withColumn("usd", providers.estimate_usd(F.col("model_used"), F.col("tokens_in"), F.col("tokens_out")))


@query(f"{_PRICED} SELECT doc_id, call_idx, model_used, usd FROM p")
def price_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("doc_id", "call_idx", "model_used", "usd")


@query(f"{_PRICED} SELECT doc_id, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(usd), 8) AS usd, arg_max(model_used, call_idx) AS model_used, count(*) AS n_calls FROM p GROUP BY doc_id")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.aggregate_cost(_calls(spark, sf_dir)).select("doc_id", "tokens_in", "tokens_out", "usd", "model_used", F.size("breakdown").cast("long").alias("n_calls"))


_KEY_SQL = "sha256(encode(text) || '\\x00'::BLOB || encode('schema-1') || '\\x00'::BLOB || encode('deterministic'))"


@query(f"SELECT doc_id, {_KEY_SQL} AS cache_key FROM documents")
def cache_key_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layouts.table(spark, sf_dir, "documents").select("doc_id", cache_key(F.col("text"), "schema-1", "deterministic").alias("cache_key"))


@query("WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, text IN (SELECT text FROM c) AS hit FROM documents")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are cached; copies of them hit too."""
    docs = cache_key_of(spark, sf_dir)
    hit, missed = split_by_cache(docs, docs.where("doc_id % 2 = 0").select("cache_key").distinct())
    return hit.select("doc_id", F.lit(True).alias("hit")).union(missed.select("doc_id", F.lit(False).alias("hit")))


_TAGS = "h1|p|li|nav|footer"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
 m AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(h, '(?i)</({_TAGS})\b[^>]*>', chr(1) || chr(2), 'g'), '(?i)<({_TAGS})\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda x: contains(x, chr(2)) AND NOT starts_with(x, chr(2))) AS ps FROM b),
 p AS (SELECT page_id, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS pos FROM m),
 t AS (SELECT page_id, pos, lower(split_part(piece, chr(2), 1)) AS tag, trim(regexp_replace(regexp_replace(split_part(piece, chr(2), 2), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM p)
 SELECT page_id AS doc_id, CAST(pos AS INT) AS block_idx, 1 AS page, CAST(50 AS DOUBLE) AS x, pos * 20.0::DOUBLE AS y, length(text) * 6.0::DOUBLE AS w, CAST(16 AS DOUBLE) AS h, CASE tag WHEN 'h1' THEN 'title' WHEN 'p' THEN 'text' WHEN 'li' THEN 'list_item' WHEN 'nav' THEN 'page_header' ELSE 'page_footer' END AS label, text FROM t WHERE text <> ''""")
def html_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(layouts.table(spark, sf_dir, "pages"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events GROUP BY ALL")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_rates(layouts.table(spark, sf_dir, "events"))


def _steps_sql(names: tuple[str, ...], total: int) -> str:
    rows = ", ".join(f"({k}, '{n}', '{TITLES[n][0]}', {total}, round({k + 1} / {total}.0, 4)::DOUBLE)" for k, n in enumerate(names))
    return f"SELECT * FROM (VALUES {rows}) AS t(step_index, name, title, total, progress)"


def _step_rows(spark: SparkSession, steps: list) -> DataFrame:
    return spark.createDataFrame([(s.index, s.name, s.title, s.total, round(s.progress, 4)) for s in steps], "step_index int, name string, title string, total int, progress double")


@query(_steps_sql(("start", "cache_check", "extract_text", "extract_blocks", "extract_rects", "fuse", "pair_fields", "apply_schema", "complete"), 9))
def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a deterministic run over the order forms."""
    from tessera.plans.extraction import Pipeline

    form, boxes = layouts.form(spark, sf_dir), layouts.form_rects(spark, sf_dir)
    return _step_rows(spark, Pipeline(SCHEMA).run(form, layouts.blocks(spark, sf_dir).where("false"), boxes).steps)


#: A scripted model over the form of an order: the first answer invents the amount, the second one copies it.
_FIRST, _SECOND = '{"cliente": "%s", "pedido": {"importe": "no consta 99"}}', '{"cliente": "%s"}'


def _model_run(spark: SparkSession, sf_dir: str, policy: str):
    from tessera.plans.extraction import Pipeline
    from tessera.plans.providers import Scripted

    def answer(prompt: str) -> str:
        at = prompt.find("Customer#")
        return (_SECOND if "could not be found" in prompt else _FIRST) % prompt[at : at + 18]

    form, boxes = layouts.form(spark, sf_dir), layouts.form_rects(spark, sf_dir)
    return Pipeline(SCHEMA, Scripted(answer), on_hallucination=policy).run(form, layouts.blocks(spark, sf_dir).where("false"), boxes)


@query("SELECT o_orderkey AS doc_id, 'cliente' AS field_name, c_name AS value, 'substring' AS match_method, '6' AS source_items FROM orders JOIN customer ON o_custkey = c_custkey")
def model_reprompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is asked again, and the second answer replaces the first."""
    bound = _model_run(spark, sf_dir, "retry").bound
    return bound.select("doc_id", "field_name", "value", "match_method", F.array_join(F.transform("source_items", lambda i: i.cast("string")), ",").alias("source_items"))


@query("SELECT o_orderkey AS doc_id, 'cliente' AS field_name FROM orders JOIN customer ON o_custkey = c_custkey")
def model_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With policy ``drop`` only what was found stays bound."""
    return _model_run(spark, sf_dir, "drop").bound.select("doc_id", "field_name")
