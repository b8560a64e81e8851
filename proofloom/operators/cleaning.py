"""Catalogue cleaning: headers, price column, product rows, forward-filled groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import parse_price
from ..functions.text import canon_header, squash_ws
from ..plans.chunks import carry_forward, position_chunk, running_sum

# Header spellings, compared after canon_header.
HEADER_ALIASES = {
    "name": ["наименование", "наименованиетовара", "название", "товар", "name", "product"],
    "brand": ["бренд", "brand", "марка"],
    "article": ["артикул", "артикултовара", "sku", "article"],
}
PRICE_HEADERS = ["price", "correctprice", "корректная"]
PRODUCT_FIELDS = ["name", "brand", "price", "article"]


def sheet_rows(cells: DataFrame, sheet_keys: list[str]) -> DataFrame:
    """Long cells (sheet keys, row, col, ctype, value) to one record per worksheet row.

    A row is bounded by the column limit of the file format, a sheet is not, so no later step
    gathers more than one row.
    """
    cell = F.struct("col", "ctype", "value")
    return cells.groupBy(*sheet_keys, "row").agg(F.collect_list(cell).alias("cells"))


def _rightmost(canonical_names: list[str]) -> Column:
    hits = F.filter("labels", lambda cell: cell["canon"].isin(canonical_names))
    return F.array_max(F.transform(hits, lambda cell: cell["col"]))


def _first_of_sheet(rows: DataFrame, sheet_keys: list[str], many: int | None) -> DataFrame:
    """The first rows of each sheet, or all of them."""
    if many is None:
        return rows
    nth_row = F.row_number().over(Window.partitionBy(*sheet_keys).orderBy("row"))
    return rows.withColumn("_nth", nth_row).where(F.col("_nth") <= many).drop("_nth")


def find_headers(rows: DataFrame, sheet_keys: list[str], first_rows: int | None = None) -> DataFrame:
    """First row of the sheet (with ``first_rows``, of so many first rows) holding all three product headers.

    One record per sheet: header_row, name_col, brand_col, article_col and ``labels``, the
    non-blank cells of that row.  Where two columns carry a header the right-most one counts.
    """
    top = _first_of_sheet(rows, sheet_keys, first_rows)
    labelled = F.transform(
        "cells",
        lambda cell: F.struct(
            cell["col"].alias("col"), squash_ws(cell["value"]).alias("label"), canon_header(squash_ws(cell["value"])).alias("canon")
        ),
    )
    top = top.withColumn("labels", F.filter(labelled, lambda cell: cell["label"] != ""))
    for field, names in HEADER_ALIASES.items():
        top = top.withColumn(f"{field}_col", _rightmost(names))
    found = ["row", "labels", *[f"{field}_col" for field in HEADER_ALIASES]]
    return (
        top.where(" and ".join(f"{field}_col is not null" for field in HEADER_ALIASES))
        .groupBy(*sheet_keys)
        .agg(F.min_by(F.struct(*found), "row").alias("_first"))
        .select(*sheet_keys, F.col("_first.row").alias("header_row"), *[F.col(f"_first.{name}") for name in found[1:]])
    )


def _cell(column: Column) -> Column:
    """First cell of the current row in the given column."""
    return F.get(F.filter("cells", lambda cell: cell["col"] == column), F.lit(0))


def infer_price_column(rows: DataFrame, sheet_keys: list[str], headers: DataFrame, sample: int | None = None, share: float = 0.5) -> DataFrame:
    """Column that holds the price of each sheet.

    A column headed "correct price" wins and must be the only one.  Otherwise the right-most of
    the labelled price columns and the blank-headed columns to their right where at least half of
    the product rows (with ``sample``, of so many first ones) hold a price.  Adds price_col, or error and a null price_col.
    """
    def is_price(cell: Column) -> Column:
        return (cell["col"] >= 3) & (cell["canon"].contains("цен") | cell["canon"].isin(PRICE_HEADERS))

    def is_marked(cell: Column) -> Column:
        named = F.lower(cell["label"]).rlike(r"(?:^|\s)корректн") | (cell["canon"] == "correctprice")
        return is_price(cell) & named & ~cell["canon"].contains("некоррект")

    def columns(condition) -> Column:
        return F.transform(F.filter("labels", condition), lambda cell: cell["col"])

    sheets = headers.withColumn("last_price_col", F.array_max(columns(is_price))).withColumn("marked", columns(is_marked))
    wanted = sheets.select(
        *sheet_keys, "header_row", "name_col", "last_price_col", F.transform("labels", lambda cell: cell["col"]).alias("labelled")
    )
    products = rows.join(wanted, sheet_keys).where(
        (F.col("row") > F.col("header_row")) & (F.coalesce(_cell(F.col("name_col"))["value"], F.lit("")) != "")
    )
    sampled = _first_of_sheet(products, sheet_keys, sample)
    blank_headed = F.filter(
        "cells", lambda cell: (cell["col"] > F.col("last_price_col")) & ~F.array_contains("labelled", cell["col"])
    )
    per_column = (
        sampled.select(*sheet_keys, F.explode_outer(blank_headed).alias("cell"))
        .groupBy(*sheet_keys, F.col("cell.col").alias("col"))
        .agg(F.count(parse_price(F.col("cell.value"))).alias("valid"))
    )
    sizes = sampled.groupBy(*sheet_keys).agg(F.count("*").alias("sample_size"))
    inferred = (
        per_column.join(sizes, sheet_keys)
        .where(F.col("valid") >= F.greatest(F.lit(1.0), F.col("sample_size") * share))
        .groupBy(*sheet_keys)
        .agg(F.max("col").alias("inferred_col"))
    )
    error = F.when(F.size("marked") > 1, "several correct-price columns").when(F.col("last_price_col").isNull(), "no price column")
    chosen = F.coalesce(F.get("marked", F.lit(0)), "inferred_col", "last_price_col")
    return (
        sheets.join(inferred, sheet_keys, "left")
        .withColumn("error", error)
        .withColumn("price_col", F.when(F.col("error").isNull(), chosen))
        .drop("marked", "last_price_col", "inferred_col")
    )


def product_rows(rows: DataFrame, sheet_keys: list[str], sheets: DataFrame) -> DataFrame:
    """Body rows with number (column 2), name, brand, price, article and their cell types.

    ``sheets`` is the result of :func:`infer_price_column`.
    """
    wanted = sheets.select(*sheet_keys, "header_row", *[f"{field}_col" for field in PRODUCT_FIELDS])
    body = rows.join(wanted, sheet_keys).where(F.col("row") > F.col("header_row"))
    picked = body.select(
        *sheet_keys, "row", _cell(F.lit(2)).alias("_number"), *[_cell(F.col(f"{field}_col")).alias(f"_{field}") for field in PRODUCT_FIELDS]
    )
    values = [squash_ws("_number.value").alias("number")]
    for field in PRODUCT_FIELDS:
        values += [F.nullif(squash_ws(f"_{field}.value"), F.lit("")).alias(field), F.col(f"_{field}.ctype").alias(f"{field}_type")]
    present = F.coalesce(*PRODUCT_FIELDS).isNotNull()
    return picked.select(*sheet_keys, "row", *values).withColumn("is_product", present)


def check_products(products: DataFrame, sheet_keys: list[str], expected_sheets: DataFrame | None = None) -> DataFrame:
    """Violations of the product-row rules: every field filled and sound, products on every sheet."""
    broken = []
    for field in PRODUCT_FIELDS:
        bad = F.col(field).isNull() | F.coalesce(F.col(f"{field}_type").isin("e", "b"), F.lit(False))
        broken.append(F.when(bad, F.lit(f"field {field}")))
    broken.append(F.when(F.col("price").isNotNull() & parse_price(F.col("price")).isNull(), F.lit("price not an amount")))
    rows = (
        products.where("is_product")
        .select(*sheet_keys, F.col("row").cast("bigint").alias("row"), F.explode(F.array_compact(F.array(*broken))).alias("rule"))
    )
    sheets = expected_sheets if expected_sheets is not None else products.select(*sheet_keys).distinct()
    empty = sheets.join(products.where("is_product").select(*sheet_keys), sheet_keys, "left_anti").select(
        *sheet_keys, F.lit(None).cast("bigint").alias("row"), F.lit("no products").alias("rule")
    )
    return rows.unionByName(empty)


def forward_fill_group(rows: DataFrame, keys: list[str], row: str, number: str, out: str, chunk_rows: int = 100_000) -> DataFrame:
    """Carry the last all-digit group number down the rows; rows before the first are dropped."""
    digits = F.when(squash_ws(number).rlike("^[0-9]+$"), squash_ws(number).cast("decimal(38,0)").cast("string"))
    marked = rows.withColumn("_number", digits)
    filled = carry_forward(marked, keys, position_chunk(F.col(row), chunk_rows), [F.col(row)], "_number", out)
    return filled.where(F.col(out).isNotNull()).drop("_number")


def group_until_blank(rows: DataFrame, keys: list[str], row: str, fields: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """Older variant: a group ends at its first wholly blank row after a product; partial rows are errors.

    ``keys`` name the group.  Adds ``partial``; blank rows and everything after the end are dropped.
    """
    blank = F.expr(" and ".join(f"{f} is null" for f in fields))
    partial = ~blank & F.expr(" or ".join(f"{f} is null" for f in fields))
    first_product = rows.where(~blank).groupBy(*keys).agg(F.min(row).alias("_first"))
    started = rows.join(first_product, keys)
    end = (
        started.where(blank & (F.col(row) > F.col("_first"))).groupBy(*keys).agg(F.min(row).alias("_end"))
    )
    return (
        started.join(end, keys, "left")
        .where(~blank & (F.col("_end").isNull() | (F.col(row) < F.col("_end"))))
        .withColumn("partial", partial)
        .drop("_first", "_end")
    )


def number_in_group(rows: DataFrame, keys: list[str], position: str, out: str, chunk_rows: int = 100_000) -> DataFrame:
    """Sequence number of each row within its key, for file naming."""
    return running_sum(
        rows, keys, position_chunk(F.col(position), chunk_rows), [F.col(position)], F.lit(1).cast("bigint"), out
    )
