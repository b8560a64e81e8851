"""Project codes, dates, page lists, relative paths and usage counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of a project's code; a parameter, since every house has its own.
CODE_PREFIX = "PRJ-0"
# Russian genitive months, and the fields providers report usage in.
MONTHS = [
    "ЯНВАРЯ", "ФЕВРАЛЯ", "МАРТА", "АПРЕЛЯ", "МАЯ", "ИЮНЯ", "ИЮЛЯ", "АВГУСТА", "СЕНТЯБРЯ", "ОКТЯБРЯ", "НОЯБРЯ", "ДЕКАБРЯ",
]
INPUT_FIELDS = ["prompt_tokens", "promptTokenCount", "input_tokens"]
OUTPUT_FIELDS = ["completion_tokens", "candidatesTokenCount", "output_tokens"]
USAGE_KEYS = ["usage", "usageMetadata"]
WORK_PREFIX = "control/work/"
KEPT_FOLDERS = ["_mat/", "mapping-evidence/", "mapping-review/"]


def date_code(day: Column, prefix: str = CODE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.date_format(day, "yyMMdd"))


def code_date(code: Column, prefix: str = CODE_PREFIX) -> Column:
    """Date of a project code; null when there is none or it is no calendar day."""
    digits = F.regexp_extract(code, f"(?i)\\Q{prefix}\\E([0-9]{{6}})", 1)
    return F.when(digits != "", F.concat(F.lit("20"), F.concat_ws("-", digits.substr(1, 2), digits.substr(3, 2), digits.substr(5, 2)))).try_cast("date")


def visible_date(day: Column) -> Column:
    """Day and genitive month, as printed."""
    months = F.array(*[F.lit(month) for month in MONTHS])
    return F.concat_ws(" ", F.day(day).cast("string"), F.element_at(months, F.month(day)))


def page_in_range(pages: Column, page: Column) -> Column:
    """Whether ``1-3, 7`` includes the page; malformed parts match nothing."""
    def holds(part: Column) -> Column:
        low = F.trim(F.substring_index(part, "-", 1))
        high = F.trim(F.regexp_replace(part, "^[^-]*-", ""))
        number = lambda text: F.when(text.rlike("^[0-9]+$"), text).try_cast("bigint")
        return F.coalesce(page.between(number(low), number(high)), F.lit(False))

    return F.exists(F.split(pages, ","), holds)


def rebase_path(path: Column, is_state_path: bool = True) -> Column:
    """Relative path of the older layout under the work folder; current paths stay."""
    slashed = F.translate(path, "\\", "/")
    kept = slashed.startswith(KEPT_FOLDERS[0])
    for folder in KEPT_FOLDERS[1:]:
        kept = kept | slashed.startswith(folder)
    moved = F.when(kept | F.lit(not is_state_path), slashed).otherwise(F.substring_index(slashed, "/", -1))
    return F.when(slashed.startswith(WORK_PREFIX) | (slashed == ""), slashed).otherwise(F.concat(F.lit(WORK_PREFIX), moved))


def usage_tokens(payload: Column, fields: list[str]) -> Column:
    """First of the named counters in the usage part of the JSON payload: the first usage object that is there."""
    part = F.coalesce(*[F.get_json_object(payload, f"$.{key}") for key in USAGE_KEYS])
    found = F.coalesce(*[F.get_json_object(part, f"$.{name}").try_cast("bigint") for name in fields])
    return F.when(found.isNotNull(), F.greatest(F.lit(0).cast("bigint"), found))
