"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule.  A policy is a version and a mask of the rules that it
asks for: applying one, comparing versions, and asking what a rule alone rejects
are bitwise operations on the ledger and never look at a text again.

All of it is DataFrame functions.  Results for odd input: null text counts as an
empty one (no words, so it fails ``too_short``); a very long text is measured
whole; repeated rows are measured each; columns that aren't carried are ignored,
and a carried one that is called like a measurement is given with ``_in`` added; an
empty table gives an empty ledger.
Windows of words are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import carried, column, given_back

WINDOW = 5
_BLANK = r"[\x20\x09-\x0D]+"
_BLANKS, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def _spread(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0))


#: In the order of their bits; a bit is never reused for another rule.
def rules() -> Sequence[Rule]:
    words = F.col("n_words")
    return (
        Rule("too_short", words < 10),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 20 * words),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words)),
    )


def mask(*names: str) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules())}
    return sum(bits[n] for n in names)


#: Versions stay as they were published; a change is a new version.
def policies() -> Mapping[str, int]:
    base = ("too_short", "repeated_windows")
    return {"base": mask(*base), "v1": mask(*base, "symbols", "repeated_lines", "word_length")}


CURRENT = "v1"


def ledger(docs: DataFrame, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns of ``carry``, the measurements, and ``fail_bits``."""
    text = F.coalesce(column(text_col), F.lit(""))
    read = docs.select(*carried(carry), text.alias("text_read")).withColumn("words_read", F.filter(F.split("text_read", _BLANK), lambda w: w != ""))
    lines = F.filter(F.split("text_read", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = read.withColumns({
        "n_words": F.size("words_read").cast("long"),
        "word_chars": F.length(F.translate("text_read", _BLANKS, "")).cast("long"),
        "n_symbols": (F.length("text_read") - F.length(F.translate("text_read", _SYMBOLS, ""))).cast("long"),
        "lines_read": lines,
    }).drop("text_read")
    at = lambda i, k: F.get("words_read", i + k)
    hashed = F.transform(F.sequence(F.lit(0), F.size("words_read") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    read = read.withColumns({
        "n_lines": F.size("lines_read").cast("long"), "n_dup_lines": (F.size("lines_read") - F.size(F.array_distinct("lines_read"))).cast("long"),
        "windows_read": F.when(F.col("n_words") >= WINDOW, hashed),
    }).drop("lines_read", "words_read")
    # most texts repeat no window: only for the others are hashes sorted with their places
    again = F.size(F.array_distinct("windows_read")) < F.size("windows_read")
    placed = F.sort_array(F.transform("windows_read", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    read = read.withColumn("sorted_read", F.when(again, placed)).drop("windows_read")
    same = lambda x, i: x["h"].eqNullSafe(F.get("sorted_read", i - 1)["h"]) | x["h"].eqNullSafe(F.get("sorted_read", i + 1)["h"])
    places = F.sort_array(F.transform(F.filter("sorted_read", same), lambda x: x["i"]))
    read = read.withColumn("places_read", places).drop("sorted_read")
    covered = F.transform("places_read", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places_read", i + 1) - p, F.lit(WINDOW))))
    read = read.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("places_read")
    bits = [F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    result = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return read.select(*given_back(carry, (*result, "fail_bits")), *result, total.cast("long").alias("fail_bits"))


def rejected_by(version: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policies()[version]).cast("long")) != 0


def ablations(rows: DataFrame) -> DataFrame:
    """Of each policy and rule in it: documents that fail the rule, that the policy rejects, and that it rejects for this rule alone.

    The ledger is counted by its masks first, so at most 2**rules rows go on.
    """
    masks = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(v, m, r.name, 1 << i) for v, m in policies().items() for i, r in enumerate(rules()) if m >> i & 1], "policy string, mask long, rule string, bit long")
    own = F.col("fail_bits").bitwiseAND(F.col("mask"))
    each = masks.join(F.broadcast(asked), own != 0, "right")
    count = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    return each.groupBy("policy", "rule").agg(count(own.bitwiseAND(F.col("bit")) != 0, "n_failed"), count(own != 0, "n_rejected"), count(own == F.col("bit"), "n_only_this"))
