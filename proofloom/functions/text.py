"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as white space, and the four separators U+001C-U+001F.
WHITESPACE = (
    r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
ISO_INSTANT = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.+-]+\b"


def squash_ws(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def blank_to_null(text: Column) -> Column:
    trimmed = strip_ws(text)
    return F.when(trimmed != "", trimmed)


def canon_header(label: Column) -> Column:
    """Header compared without case, blanks or punctuation; Cyrillic yo equals ye."""
    return F.regexp_replace(F.translate(F.lower(label), "ё", "е"), "[^а-яa-z0-9]", "")


def col_index(letters: Column) -> Column:
    """Spreadsheet column letters to a number from 1 (no zero digit, base 26)."""
    codes = F.transform(F.split(letters, ""), lambda letter: F.ascii(letter).cast("bigint") - 64)
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda total, code: total * 26 + code)


def col_letter(number: Column) -> Column:
    """Inverse of :func:`col_index` for any number up to 26**12."""
    start = F.struct(number.cast("bigint").alias("rest"), F.lit("").alias("letters"))

    def place(state: Column, _step: Column) -> Column:
        rest = state["rest"]
        letter = F.when(rest > 0, F.char((rest - 1) % 26 + 65)).otherwise("")
        return F.struct(
            F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(F.lit(0)).cast("bigint").alias("rest"),
            F.concat(letter, state["letters"]).alias("letters"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, place)["letters"]


def sanitize_note(note: Column) -> Column:
    """Note safe for the ``id=note||id=note`` transport."""
    return squash_ws(F.replace(note, F.lit("||"), F.lit(";")))


def note_long_enough(sanitized: Column, minimum: int = 25) -> Column:
    return F.char_length(sanitized) >= minimum


def stable_error_text(text: Column) -> Column:
    """Error text without the parts that differ between two runs of the same failure."""
    return F.regexp_replace(squash_ws(text), ISO_INSTANT, "<time>")


def extract_ids(text: Column) -> Column:
    """Distinct ids in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"(?U)\bLOOK_[0-9]{3,}\b"), F.lit(0)))


def estimate_tokens(text: Column, images: Column) -> Column:
    """Four UTF-8 bytes per token, at least one, and 4096 per image."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)) + images * 4096


def next_revision(stem: Column) -> Column:
    """``name_07`` to ``name_08``, at least as wide as before; null without a numeric suffix."""
    pattern = r"^((?s).+)_([0-9]{2,})$"
    digits = F.regexp_extract(stem, pattern, 2)
    grown = digits.try_cast("decimal(38,0)") + 1
    text = grown.cast("string")
    width = F.greatest(F.char_length(digits), F.char_length(text))
    return F.when(digits != "", F.concat(F.regexp_extract(stem, pattern, 1), F.lit("_"), F.lpad(text, width, F.lit("0"))))
