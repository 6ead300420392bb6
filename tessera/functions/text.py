"""Text operators as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a label, what a font name says of weight and slant.
LABEL_ENDS = ":："
BOLD, ITALIC = "bold|black|heavy", "italic|oblique"


def _folding() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks and of full width that decompose into one letter and marks, and these letters."""
    blocks = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0xFF00, 0xFFF0))
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for block in blocks for c in range(*block)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: What ``(?U)\\s`` matches.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def normalize(text: Column) -> Column:
    """Strip, lower, one space for each stretch of white space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def fold_accents(text: Column) -> Column:
    """Precomposed letters by their base letters, then without combining marks."""
    return F.regexp_replace(F.translate(text, *_folding()), r"\p{M}+", "")


def normalize_label(text: Column) -> Column:
    """Without colons at the end, accents or case, white space collapsed."""
    bare = strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), f"[{LABEL_ENDS}]+\\z", ""))
    return strip(F.regexp_replace(F.lower(fold_accents(bare)), r"(?U)\s+", " "))


def is_label(text: Column) -> Column:
    """T3."""
    return F.coalesce(strip(text).rlike(f"[{LABEL_ENDS}]\\z"), F.lit(False))


def strip_label(text: Column) -> Column:
    """T4: colons go first, then blanks; a label with a blank after its colon keeps the colon."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{LABEL_ENDS}]+\\z", ""))


def is_bold(font: Column) -> Column:
    """T5."""
    return F.coalesce(F.lower(font).rlike(BOLD), F.lit(False))


def is_italic(font: Column) -> Column:
    return F.coalesce(F.lower(font).rlike(ITALIC), F.lit(False))


def parse_json_object(text: Column) -> Column:
    """VARIANT of the object in an answer: inside a markdown fence, as it stands, or from the first { to the last }; else {}."""
    bare = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(bare, r"(?s)^```(?:json)?\s*(.*?)\s*```\z", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    whole, part = F.try_parse_json(body), F.try_parse_json(inner)
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(whole.isNull() & is_object(part), part).otherwise(F.parse_json(F.lit("{}")))
