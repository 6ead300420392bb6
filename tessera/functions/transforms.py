"""Transformers: a raw text Column to STRUCT<normalized, score, issues>, all by built-in expressions.

Blank input gives (null, 0, ["empty"]).  Libraries that check more than the
formats here are not used; scores are those of the formats alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip

Case = tuple[Column | bool, Column | None, float | Column, str | None]
MONEY, MONEY_TYPE = "decimal(38,9)", "struct<amount:decimal(38,9),currency:string>"


def _issues(name: str | None) -> Column:
    return (F.array(F.lit(name)) if name else F.array()).cast("array<string>")


def _verdict(kind: str, cases: Sequence[Case]) -> Column:
    """The first case that holds; the last one has ``True``."""
    out = None
    for cond, value, score, issue in reversed(cases):
        own = F.struct((F.lit(None) if value is None else value).cast(kind).alias("normalized"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("score"), _issues(issue).alias("issues"))
        out = own if cond is True else F.when(F.coalesce(cond, F.lit(False)), own).otherwise(out)
    return out


def _text(raw: Column) -> Column:
    return strip(F.coalesce(raw, F.lit("")))


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(rf"^(?:{pattern})\z")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lookup(pairs: Sequence[tuple[str, object]], key: Column) -> Column:
    """Value of a small literal map; of equal keys the last pair counts."""
    flat = [x for k, v in dict(pairs).items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*flat), key) if flat else F.lit(None).cast("string")


@dataclass(frozen=True)
class Transformer:
    """``apply(raw, **context)``; ``options`` are those of a checkbox field, in declared order."""

    name: str
    kind: str
    apply: Callable[..., Column]
    options: tuple[str, ...] | None = field(default=None)
    python: bool = False

    def __call__(self, raw: Column, **context: Column) -> Column:
        if self.python:
            return self.apply(raw, **context)
        # bound once: the cases below name it often, and inlined they outgrow generated code
        return _let(raw, lambda r: self.apply(r, **context))


# --- generic


def regex(pattern: str, name: str = "regex") -> Transformer:
    """Whole match of the stripped text."""
    return Transformer(name, "string", lambda raw, **_: _verdict("string", [(_text(raw) == "", None, 0.0, "empty"), (_matches(_text(raw), pattern), _text(raw), 1.0, None), (True, None, 0.0, "regex_no_match")]))


def enum(values: Sequence[str], case_insensitive: bool = True, name: str = "enum") -> Transformer:
    """Canonical value."""

    def apply(raw: Column, **_: Column) -> Column:
        t = _text(raw)
        found = _lookup([(v.lower() if case_insensitive else v, v) for v in values], F.lower(t) if case_insensitive else t)
        return _verdict("string", [(t == "", None, 0.0, "empty"), (found.isNotNull(), found, 1.0, None), (True, None, 0.0, "not_in_enum")])

    return Transformer(name, "string", apply)


def compose(*steps: Transformer) -> Transformer:
    """Each step reads the text of the last one's value; scores multiply, issues add up, a null stops."""

    def apply(raw: Column, **context: Column) -> Column:
        out = steps[0](raw, **context)
        kind = steps[0].kind
        for step in steps[1:]:
            before = out
            value = before["normalized"]
            said = money_text(value) if kind == MONEY_TYPE else value.cast("string")
            after = step(said, **context)
            joined = F.struct(after["normalized"].alias("normalized"), F.round(before["score"] * after["score"], 4).alias("score"), F.concat(before["issues"], after["issues"]).alias("issues"))
            stopped = F.struct(F.lit(None).cast(step.kind).alias("normalized"), before["score"].alias("score"), before["issues"].alias("issues"))
            out, kind = F.when(value.isNull(), stopped).otherwise(joined), step.kind
        return out

    return Transformer(f"compose({', '.join(s.name for s in steps)})", steps[-1].kind, apply)


# --- dates

#: Spanish month names and abbreviations.
MONTHS = (
    ("enero", 1), ("febrero", 2), ("marzo", 3), ("abril", 4), ("mayo", 5), ("junio", 6), ("julio", 7), ("agosto", 8), ("septiembre", 9), ("setiembre", 9), ("octubre", 10), ("noviembre", 11), ("diciembre", 12),
    ("ene", 1), ("feb", 2), ("mar", 3), ("abr", 4), ("may", 5), ("jun", 6), ("jul", 7), ("ago", 8), ("sep", 9), ("sept", 9), ("oct", 10), ("nov", 11), ("dic", 12),
)
_NUMERIC = r"(?U)^\s*([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})\s*\z"
_LONG = r"(?iU)^\s*([0-9]{1,2})\s+(?:de\s+)?([A-Za-zÀ-ÿ]+)(?:\s+(?:de|del)\s+([0-9]{2,4}))?\s*\z"
_ISO = r"(?U)^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})\s*\z"
_ISO_TIME = r"(?U)^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\.[0-9]+)?(?:Z|[+\-][0-9]{2}:?[0-9]{2})?\s*\z"


def expand_year(year: Column) -> Column:
    """Two digits to 2000-2029 and 1930-1999."""
    return F.when(year >= 100, year).when(year < 30, year + 2000).otherwise(year + 1900)


def try_date(year: Column, month: Column, day: Column) -> Column:
    """Null for a day that doesn't exist."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d")


def _part(raw: Column, pattern: str, k: int) -> Column:
    """Of a group as int, null if it is empty."""
    return F.nullif(F.regexp_extract(raw, pattern, k), F.lit("")).try_cast("int")


def _numeric_cases(raw: Column) -> list[Case]:
    found = try_date(expand_year(_part(raw, _NUMERIC, 3)), _part(raw, _NUMERIC, 2), _part(raw, _NUMERIC, 1))
    hit = raw.rlike(_NUMERIC)
    return [(hit & found.isNotNull(), found, 1.0, None), (hit, None, 0.0, "invalid_date")]


def _long_cases(raw: Column, as_of: Column) -> list[Case]:
    month = _lookup(MONTHS, F.lower(F.regexp_extract(raw, _LONG, 2)))
    said = _part(raw, _LONG, 3)
    found = try_date(F.coalesce(expand_year(said), F.year(as_of)), month, _part(raw, _LONG, 1))
    hit = raw.rlike(_LONG)
    return [(hit & month.isNull(), None, 0.0, "unknown_month"), (hit & found.isNull(), None, 0.0, "invalid_date"), (hit & said.isNull(), found, 0.7, "year_inferred"), (hit, found, 1.0, None)]


def _date(name: str, cases: Callable[[Column, Column], list[Case]]) -> Transformer:
    def apply(raw: Column, as_of: Column | None = None, **_: Column) -> Column:
        raw = F.coalesce(raw, F.lit(""))
        return _verdict("date", [(_text(raw) == "", None, 0.0, "empty"), *cases(raw, F.current_date() if as_of is None else as_of), (True, None, 0.0, "format_unrecognized")])

    return Transformer(name, "date", apply)


date_es = _date("date_es", lambda raw, as_of: [*_numeric_cases(raw), *_long_cases(raw, as_of)])
date_es_short = _date("date_es_short", lambda raw, as_of: _numeric_cases(raw))
date_es_long = _date("date_es_long", _long_cases)


def _iso_cases(raw: Column, as_of: Column) -> list[Case]:
    found = try_date(*(_part(raw, _ISO, k) for k in (1, 2, 3)))
    return [(raw.rlike(_ISO) & found.isNotNull(), found, 1.0, None), (raw.rlike(_ISO), None, 0.0, "invalid_date")]


date_iso = _date("date_iso", _iso_cases)


def _datetime_iso(raw: Column, **_: Column) -> Column:
    """Wall clock, fraction and offset dropped; besides, dates alone in the usual and the compact form."""
    raw = F.coalesce(raw, F.lit(""))
    t = _text(raw)
    y, mo, d, h, mi = (_part(raw, _ISO_TIME, k) for k in range(1, 6))
    s = F.coalesce(_part(raw, _ISO_TIME, 6), F.lit(0))
    day = try_date(y, mo, d)
    clock = (h < 24) & (mi < 60) & (s < 60)
    stamp = F.when(day.isNotNull() & clock, F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (h, mi, s))))).cast("timestamp_ntz"))
    alone = F.coalesce(F.when(_matches(t, "[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(t, "yyyy-MM-dd")), F.when(_matches(t, "[0-9]{8}"), F.try_to_date(t, "yyyyMMdd"))).cast("timestamp_ntz")
    return _verdict("timestamp_ntz", [(t == "", None, 0.0, "empty"), (raw.rlike(_ISO_TIME) & stamp.isNotNull(), stamp, 1.0, None), (raw.rlike(_ISO_TIME), None, 0.0, "invalid_datetime"), (alone.isNotNull(), alone, 1.0, None), (True, None, 0.0, "invalid_datetime")])


datetime_iso = Transformer("datetime_iso", "timestamp_ntz", _datetime_iso)

# --- numbers

#: Currency signs in the order they are looked for, and codes.
SIGNS = (("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("¥", "JPY"))
_CODES = r"(?iU)\b(EUR|USD|GBP|JPY|CHF|CAD|AUD)\b"
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _number(text: Column) -> Column:
    return F.when(_matches(text, _NUMBER), text.try_cast(MONEY))


def strip_currency(raw: Column) -> Column:
    """STRUCT<body, currency>: the first sign goes everywhere, then codes go and name the currency."""
    t = _text(raw)
    mark, sign = F.lit(""), F.lit(None).cast("string")
    for m, code in reversed(SIGNS):
        here = F.contains(t, F.lit(m))
        mark, sign = F.when(here, m).otherwise(mark), F.when(here, code).otherwise(sign)
    return _let(F.struct(F.replace(t, mark, F.lit("")).alias("text"), sign.alias("sign")), lambda s: F.struct(
        strip(F.regexp_replace(s["text"], _CODES, "")).alias("body"), F.coalesce(F.upper(F.nullif(F.regexp_extract(s["text"], _CODES, 1), F.lit(""))), s["sign"]).alias("currency"),
    ))


def parse_eu(text: Column) -> Column:
    """Dots group, a comma is the decimal sign."""
    return _number(F.translate(text, ",.  ", "."))


def parse_us(text: Column) -> Column:
    return _number(F.translate(text, ",  ", ""))


def _last(text: Column, mark: str) -> Column:
    at = F.instr(F.reverse(text), mark)
    return F.when(at > 0, F.length(text) - at).otherwise(-1)


def _money(amount: Column, currency: Column) -> Column:
    return F.struct(amount.alias("amount"), currency.cast("string").alias("currency"))


def money_text(money: Column) -> Column:
    """Amount and currency with a blank between."""
    return F.when(money.isNotNull(), F.concat_ws(" ", money["amount"].cast("string"), money["currency"]))


def _amount(name: str, parse: Callable[[Column], Column], forced: str | None = None) -> Transformer:
    def verdict(said: Column) -> Column:
        """Of STRUCT<blank, amount, currency>."""
        amount, currency = said["amount"], said["currency"]
        cases: list[Case] = [(said["blank"], None, 0.0, "empty"), (amount.isNull(), None, 0.0, "amount_unparseable")]
        if forced:
            return _verdict(MONEY_TYPE, [*cases, (True, _money(amount, F.lit(forced)), 1.0, None)])
        return _verdict(MONEY_TYPE, [*cases, (currency.isNull(), _money(amount, currency), 0.7, "currency_ambiguous"), (True, _money(amount, currency), 1.0, None)])

    def apply(raw: Column, **_: Column) -> Column:
        blank = (_text(raw) == "").alias("blank")
        return _let(strip_currency(raw), lambda s: _let(F.struct(blank, parse(s["body"]).alias("amount"), s["currency"].alias("currency")), verdict))

    return Transformer(name, MONEY_TYPE, apply)


amount_eu, amount_us = _amount("amount_eu", parse_eu), _amount("amount_us", parse_us)
amount_eur, amount_usd = _amount("amount_eur", parse_eu, "EUR"), _amount("amount_usd", parse_us, "USD")


def amount_currency(code: str) -> Transformer:
    """The currency's own convention, else the other one."""
    first, second = (parse_eu, parse_us) if code.upper() == "EUR" else (parse_us, parse_eu)
    return _amount(f"amount_currency({code!r})", lambda body: F.coalesce(first(body), second(body)), code.upper())


def _by_last(eu: Column, us: Column, none: Column, text: Column) -> Column:
    return _let(F.struct(_last(text, ",").alias("comma"), _last(text, ".").alias("dot")), lambda at: F.when(at["comma"] > at["dot"], eu).when(at["dot"] > at["comma"], us).otherwise(none))


#: The last separator is the decimal sign.
amount_auto = _amount("amount_auto", lambda body: _by_last(parse_eu(body), parse_us(body), _number(F.replace(body, F.lit(" "), F.lit(""))), body))


def _plain(name: str, kind: str, body: Callable[[Column], Column], value: Callable[[Column], Column], issue: str) -> Transformer:
    def apply(raw: Column, **_: Column) -> Column:
        said = F.struct((_text(raw) == "").alias("blank"), value(body(_text(raw))).alias("found"))
        return _let(said, lambda s: _verdict(kind, [(s["blank"], None, 0.0, "empty"), (s["found"].isNotNull(), s["found"], 1.0, None), (True, None, 0.0, issue)]))

    return Transformer(name, kind, apply)


def _decimal(text: Column) -> Column:
    return _by_last(_number(F.translate(text, ",.", ".")), _number(F.replace(text, F.lit(","), F.lit(""))), _number(text), text)


#: Separators go first in an integer; a percentage is not divided.
integer = _plain("integer", "long", lambda t: F.translate(t, " .,", ""), lambda t: F.when(_matches(t, "-?[0-9]+"), t.try_cast("long")), "integer_format_invalid")
decimal = _plain("decimal", MONEY, lambda t: F.translate(t, " ", ""), _decimal, "decimal_format_invalid")
percentage = _plain("percentage", MONEY, lambda t: F.translate(t, "% ", ""), _decimal, "percentage_format_invalid")

# --- identifiers

#: Check letters, formats.
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
_NIF, _NIE, _CIF = "[0-9]{8}[A-Z]", "[XYZ][0-9]{7}[A-Z]", "[ABCDEFGHJKLMNPQRSUVW][0-9]{7}[0-9A-J]"
_IBAN, _BIC = "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?"
_EMAIL, _PHONE_ES = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"(?:\+34|0034)?[6789][0-9]{8}"


def _id_text(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"(?U)[\s\-./]", "")


def _lettered(name: str, pattern: str, digits: Callable[[Column], Column], issue: str) -> Transformer:
    def apply(raw: Column, **_: Column) -> Column:
        t = _id_text(raw)
        number = digits(F.substring(t, 1, 8)).try_cast("int")
        right = F.substring(F.lit(NIF_LETTERS), (number % 23 + 1).cast("int"), F.lit(1)) == F.substring(t, 9, 1)
        return _verdict("string", [(t == "", None, 0.0, "empty"), (~_matches(t, pattern), None, 0.0, f"{issue}_format_invalid"), (right, t, 1.0, None), (True, t, 0.5, f"{issue}_checksum_mismatch")])

    return Transformer(name, "string", apply)


nif_es = _lettered("nif_es", _NIF, lambda t: t, "nif")
nie_es = _lettered("nie_es", _NIE, lambda t: F.translate(t, "XYZ", "012"), "nie")


def _formatted(name: str, text: Callable[[Column], Column], pattern: str, score: float, issue: str) -> Transformer:
    def apply(raw: Column, **_: Column) -> Column:
        t = text(raw)
        return _verdict("string", [(t == "", None, 0.0, "empty"), (_matches(t, pattern), t, score, None), (True, None, 0.0, issue)])

    return Transformer(name, "string", apply)


def _cif_digit_ok(t: Column) -> Column:
    digits = F.transform(F.sequence(F.lit(2), F.lit(8)), lambda i: F.substring(t, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10)
    check = (10 - total % 10) % 10
    last = F.substring(t, 9, 1)
    return (last == check.cast("string")) | (last == F.substring(F.lit("JABCDEFGHI"), (check + 1).cast("int"), F.lit(1)))


def cif(strict: bool = False) -> Transformer:
    """The format scores 0.8; ``strict`` checks the control character too."""
    if not strict:
        return _formatted("cif_es", _id_text, _CIF, 0.8, "cif_format_invalid")

    def apply(raw: Column, **_: Column) -> Column:
        t = _id_text(raw)
        return _verdict("string", [(t == "", None, 0.0, "empty"), (~_matches(t, _CIF), None, 0.0, "cif_format_invalid"), (_cif_digit_ok(t), t, 1.0, None), (True, t, 0.5, "cif_checksum_mismatch")])

    return Transformer("cif_es", "string", apply)


cif_es = cif()


def _bank_text(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), r"(?U)\s+", "")


def iban_remainder(t: Column) -> Column:
    """Of an IBAN, first four characters last and letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))
    codes = F.transform(F.split(moved, ""), lambda c: F.when(c == "", None).when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, v: F.when(v.isNull(), a).when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97))


def _iban(raw: Column, **_: Column) -> Column:
    t = _bank_text(raw)
    return _verdict("string", [(t == "", None, 0.0, "empty"), (~_matches(t, _IBAN), None, 0.0, "iban_format_invalid"), (iban_remainder(t) == 1, t, 1.0, None), (True, t, 0.5, "iban_checksum_mismatch")])


iban = Transformer("iban", "string", _iban)
bic = _formatted("bic", _bank_text, _BIC, 0.9, "bic_format_invalid")


def _phone_text(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)[\s\-().]", "")


def _phone_es(raw: Column, **_: Column) -> Column:
    t = _phone_text(raw)
    return _verdict("string", [(t == "", None, 0.0, "empty"), (_matches(t, _PHONE_ES), F.concat(F.lit("+34"), F.right(t, F.lit(9))), 1.0, None), (True, t, 0.0, "phone_format_invalid")])


def _phone_international(raw: Column, **_: Column) -> Column:
    t = _phone_text(raw)
    return _verdict("string", [(t == "", None, 0.0, "empty"), (~t.startswith("+"), t, 0.0, "missing_country_code"), (True, t, 0.7, None)])


phone_es, phone_international = Transformer("phone_es", "string", _phone_es), Transformer("phone_international", "string", _phone_international)
email = _formatted("email", lambda raw: F.lower(_text(raw)), _EMAIL, 1.0, "email_format_invalid")


def _url(raw: Column, **_: Column) -> Column:
    t = _text(raw)
    full = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    # a scheme and something before the first slash, question mark or hash
    good = full.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]")
    return _verdict("string", [(t == "", None, 0.0, "empty"), (good, full, 1.0, None), (True, None, 0.0, "url_invalid")])


url = Transformer("url", "string", _url)

#: Provinces by the first two digits of a postal code, 01 to 52.
PROVINCES = (
    "Álava", "Albacete", "Alicante", "Almería", "Ávila", "Badajoz", "Illes Balears", "Barcelona", "Burgos", "Cáceres", "Cádiz", "Castellón", "Ciudad Real", "Córdoba", "A Coruña", "Cuenca", "Girona",
    "Granada", "Guadalajara", "Gipuzkoa", "Huelva", "Huesca", "Jaén", "León", "Lleida", "La Rioja", "Lugo", "Madrid", "Málaga", "Murcia", "Navarra", "Ourense", "Asturias", "Palencia", "Las Palmas",
    "Pontevedra", "Salamanca", "Santa Cruz de Tenerife", "Cantabria", "Segovia", "Sevilla", "Soria", "Tarragona", "Teruel", "Toledo", "Valencia", "Valladolid", "Bizkaia", "Zamora", "Zaragoza", "Ceuta", "Melilla",
)


def _postal(raw: Column, **_: Column) -> Column:
    t = _text(raw)
    known = F.substring(t, 1, 2).try_cast("int").between(1, len(PROVINCES))
    return _verdict("string", [(t == "", None, 0.0, "empty"), (~_matches(t, "[0-9]{5}"), None, 0.0, "postal_code_invalid"), (known, t, 1.0, None), (True, t, 0.5, "postal_code_prefix_unknown")])


def _province(raw: Column, **_: Column) -> Column:
    t = _text(raw)
    found = _lookup([(p.lower(), p) for p in PROVINCES], F.lower(t))
    return _verdict("string", [(t == "", None, 0.0, "empty"), (found.isNotNull(), found, 1.0, None), (True, t, 0.5, "province_unknown")])


postal_code_es, province_es = Transformer("postal_code_es", "string", _postal), Transformer("province_es", "string", _province)

# --- forms


def checkbox_choice(choices: Sequence[str]) -> Transformer:
    """Context ``n_boxes`` and ``any_filled`` of checkboxes nearby."""

    def apply(raw: Column, n_boxes: Column | None = None, any_filled: Column | None = None, **_: Column) -> Column:
        t = _text(raw)
        found = _lookup([(c.lower(), c) for c in choices], F.lower(t))
        near = F.coalesce(F.lit(0) if n_boxes is None else n_boxes, F.lit(0)) > 0
        filled = F.coalesce(F.lit(False) if any_filled is None else any_filled, F.lit(False))
        return _verdict("string", [(t == "", None, 0.0, "empty"), (found.isNull(), None, 0.0, "not_in_choices"), (~near, found, 0.9, None), (filled, found, 1.0, None), (True, found, 0.7, "no_filled_checkbox_nearby")])

    return Transformer(f"checkbox_choice({list(choices)!r})", "string", apply, tuple(choices))


def checkbox_binary(true_label: str, false_label: str) -> Transformer:
    """X34."""

    def apply(raw: Column, **_: Column) -> Column:
        t = F.lower(_text(raw))
        return _verdict("boolean", [(t == "", None, 0.0, "empty"), (t == true_label.lower(), F.lit(True), 1.0, None), (t == false_label.lower(), F.lit(False), 1.0, None), (True, None, 0.0, "not_binary_label")])

    return Transformer(f"checkbox_binary({true_label!r},{false_label!r})", "boolean", apply, (true_label, false_label))


def multi_checkbox(choices: Sequence[str], sep: str = ",") -> Transformer:
    """The known parts; others lower the score."""

    def apply(raw: Column, **_: Column) -> Column:
        t = _text(raw)
        parts = F.filter(F.transform(F.split(t, f"\\Q{sep}\\E"), strip), lambda p: p != "")
        found = F.transform(parts, lambda p: _lookup([(c.lower(), c) for c in choices], F.lower(p)))
        known = F.filter(found, lambda x: x.isNotNull())
        none = F.array().cast("array<string>")
        return _verdict("array<string>", [(t == "", none, 0.0, "empty"), (F.exists(found, lambda x: x.isNull()), known, 0.6, "unknown_choice"), (True, known, 1.0, None)])

    return Transformer(f"multi_checkbox({list(choices)!r})", "array<string>", apply)


def from_python(name: str, kind: str, function: Callable[[str | None], tuple[object, float, Sequence[str]]]) -> Transformer:
    """A custom transformer: ``function(raw)`` to (normalized, score, issues), run in Arrow batches; an exception becomes an issue."""
    schema = f"normalized {kind}, score double, issues array<string>"

    def apply(raw: Column, **_: Column) -> Column:
        @F.pandas_udf(schema)
        def run(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for t in texts:
                try:
                    value, score, issues = function(t)
                    rows.append((value, float(score), list(issues)))
                except Exception as e:  # noqa: BLE001  the contract turns any failure into an issue
                    rows.append((None, 0.0, [f"transform_exception:{type(e).__name__}"]))
            return pd.DataFrame(rows, columns=["normalized", "score", "issues"])

        return run(raw)

    return Transformer(name, kind, apply, None, True)
