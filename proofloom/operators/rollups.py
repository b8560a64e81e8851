"""Status counts, fingerprints, page ranges, progress and best-of selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clearance import status_rank
from ..functions.text import strip_ws
from ..plans.chunks import number_rows, position_chunk
from ..plans.lineage import cut_lineage

OUTPUTS = 5  # fixed value: final documents of a finished project


def _status() -> Column:
    return F.coalesce(F.nullif(F.upper(strip_ws(F.col("status"))), F.lit("")), F.lit("REVIEW"))


def audit_items(items: DataFrame, look: str) -> DataFrame:
    """Items with an id; a blank status counts as REVIEW."""
    return items.where(strip_ws(F.coalesce(F.col(look).cast("string"), F.lit(""))) != "").withColumn("status", _status())


def status_summary(items: DataFrame, keys: list[str], look: str) -> DataFrame:
    """Items per status."""
    return audit_items(items, look).groupBy(*keys, "status").agg(F.count("*").alias("looks"))


def blocked_items(items: DataFrame, look: str) -> DataFrame:
    return audit_items(items, look).where("status <> 'CLEAR'")


def all_pass(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("status") == "CLEAR", F.lit(False))).alias("passed"))


def expected_fields(captions: DataFrame, visible: DataFrame, look: str) -> DataFrame:
    """Four printed fields per product against the fields found on the page."""
    expected = captions.groupBy(look).agg((F.count("*") * 4).alias("expected"))
    return visible.join(expected, look, "left").select(
        look, "visible", F.coalesce("expected", F.lit(0)).alias("expected"), (F.col("visible") >= F.coalesce("expected", F.lit(0))).alias("complete")
    )


def fingerprint(members: DataFrame, group: list[str], member: str, value: Column, chunk: Column) -> DataFrame:
    """Two-level SHA-256 of the group's values in member order; empty if any value is missing.

    Each chunk hashes its values, one per line; the group hashes its chunk hashes, one per line, however
    many there are.  The chunks are part of the definition: ``chunk`` must not decrease with the member
    and should hold about as many members as it has chunks, so that both levels stay small.
    """
    rows = members.select(*group, F.col(member).alias("_member"), value.alias("_value"), chunk.alias("_chunk"))

    def digest(pairs: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda pair: pair["text"]), "\n"), 256)

    per_chunk = rows.groupBy(*group, "_chunk").agg(
        digest(F.collect_list(F.struct(F.col("_member").alias("at"), F.col("_value").alias("text")))).alias("_digest"),
        F.bool_or(F.col("_value").isNull()).alias("_gap"),
    )
    combined = digest(F.collect_list(F.struct(F.col("_chunk").alias("at"), F.col("_digest").alias("text"))))
    return per_chunk.groupBy(*group).agg(
        F.when(F.bool_or("_gap"), "").otherwise(combined).alias("fingerprint")
    )


def cover_pages(pages: DataFrame, book: list[str], page: str, photos: str) -> DataFrame:
    """Leading cover pages: 0 if page one shows two photos, 1 if page two does, else an error."""
    first = F.max(F.when(F.col(page) == 1, F.col(photos)))
    second = F.max(F.when(F.col(page) == 2, F.col(photos)))
    cover = F.when(first == 2, 0).when(second == 2, 1)
    return pages.groupBy(*book).agg(cover.alias("cover_pages"), cover.isNull().alias("undecided"))


def page_islands(pages: DataFrame, keys: list[str], page: str, chunk_pages: int = 100_000) -> DataFrame:
    """Runs of consecutive pages: keys, first, last."""
    distinct = pages.select(*keys, page).distinct()
    numbered = number_rows(distinct, keys, position_chunk(F.col(page), chunk_pages), [F.col(page)], "_n")
    return numbered.groupBy(*keys, (F.col(page) - F.col("_n")).alias("_run")).agg(F.min(page).alias("first"), F.max(page).alias("last")).drop("_run")


def compact_ranges(pages: DataFrame, keys: list[str], page: str, chunk_pages: int = 100_000) -> DataFrame:
    """Page list of each key as ``1-3,7``."""
    runs = page_islands(pages, keys, page, chunk_pages)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("first"), text.alias("text"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda run: run["text"]), ",").alias("page_range"))


def edition_pages(looks: DataFrame, book: list[str], expected_pages: DataFrame) -> DataFrame:
    """Page range and count of each book's M and W edition, with the shared first and last page.

    ``looks``: book, excel_sheet, left_page, right_page.  ``expected_pages``: book, last_page.
    A book lacking one edition gets a row with a null range.
    """
    editions = F.explode(F.array(F.lit("M"), F.lit("W")))
    own = looks.select(*book, F.upper("excel_sheet").alias("edition"), F.explode(F.array("left_page", "right_page")).alias("page")).where(F.col("edition").isin("M", "W"))
    present = own.select(*book, "edition").distinct()
    covers = present.join(expected_pages, book).select(*book, "edition", F.explode(F.array(F.lit(1).cast("bigint"), F.col("last_page").cast("bigint"))).alias("page"))
    pages = own.select(*book, "edition", F.col("page").cast("bigint").alias("page")).unionByName(covers)
    counts = pages.groupBy(*book, "edition").agg(F.count("*").alias("pages"))
    ranges = compact_ranges(pages, [*book, "edition"], "page").join(counts, [*book, "edition"])
    return expected_pages.select(*book, editions.alias("edition")).join(ranges, [*book, "edition"], "left")


def progress(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Done of total per phase; in targeted mode only changed items count.

    ``steps``: keys, status, targeted, changed.
    """
    counted = ~F.col("targeted") | F.col("changed")
    return steps.groupBy(*keys).agg(
        F.count(F.when(counted & (F.col("status") == "passed"), 1)).alias("done"), F.count(F.when(counted, 1)).alias("total")
    )


def outputs_complete(outputs: DataFrame, key: str, required_format: str) -> DataFrame:
    """Finished documents per project: the larger of verified and written ones in the right format."""
    right = F.col("format") == required_format
    verified, written = F.count(F.when(right & F.col("verified"), 1)), F.count(F.when(right & F.col("written"), 1))
    return outputs.groupBy(key).agg(
        F.greatest(verified, written).alias("complete"),
        ((F.count("*") == OUTPUTS) & F.bool_and(right) & F.bool_or("finished")).alias("final"),
    )


def first_incomplete(stages: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """First stage in order that has not passed, or the last stage; and how many passed before it.

    ``stages``: keys, order from 0 without gap, stage name, status.
    """
    open_stage = F.when(F.coalesce(F.col("status") != "passed", F.lit(True)), F.col(order))
    return stages.groupBy(*keys).agg(
        F.coalesce(F.min_by(name, open_stage), F.max_by(name, order)).alias("current"),
        F.coalesce(F.min(open_stage), F.max(order) + 1).alias("passed_prefix"),
    )


def reset_from(stages: DataFrame, from_order: Column, order: str) -> DataFrame:
    """Stages from the given one back to pending."""
    reset = F.col(order) >= from_order
    blank = {"started_at": F.lit(None), "completed_at": F.lit(None), "error": F.lit("")}
    changed = stages.withColumn("status", F.when(reset, "pending").otherwise(F.col("status")))
    for column, value in blank.items():
        changed = changed.withColumn(column, F.when(reset, value).otherwise(F.col(column)))
    return changed


def confirm_prior(stages: DataFrame, before_order: Column, order: str, now: Column) -> DataFrame:
    """Stages before the given one passed, keeping an earlier start."""
    prior = F.col(order) < before_order
    return (
        stages.withColumn("status", F.when(prior, "passed").otherwise(F.col("status")))
        .withColumn("started_at", F.when(prior, F.coalesce("started_at", now)).otherwise(F.col("started_at")))
        .withColumn("completed_at", F.when(prior, now).otherwise(F.col("completed_at")))
        .withColumn("error", F.when(prior, "").otherwise(F.col("error")))
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order."""
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def latest_matching(records: DataFrame, matches: Column, key: str, active: str, at: str, tie: str) -> DataFrame:
    """Newest record per key among the matching ones; the active one wins over history."""
    rest = [name for name in records.columns if name != key]
    return (
        records.where(matches).groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(active), F.col(at), F.col(tie))).alias("_row")).select(key, "_row.*")
    )


def best_shift(candidates: DataFrame, look: str) -> DataFrame:
    """Safest shift per look: status, coverage, largest component, then the smallest move.

    ``candidates``: look, shift, fine, status, coverage, component.  Fine-grid rows count only
    where the coarse grid has no CLEAR shift.
    """
    rank = F.struct(status_rank(F.col("status")), F.col("coverage"), F.col("component"), F.abs("shift"), F.col("shift"))
    row = F.struct("shift", "status", "coverage", "component")
    best = candidates.groupBy(look).agg(
        F.min_by(row, F.when(~F.col("fine"), rank)).alias("_coarse"), F.min_by(row, rank).alias("_any")
    )
    return best.select(look, F.when(F.col("_coarse.status") == "CLEAR", F.col("_coarse")).otherwise(F.col("_any")).alias("_best")).select(look, "_best.*")


def best_combined(candidates: DataFrame, look: str, preferred: str, current: str) -> DataFrame:
    """Crop and frame move nearest the preferred, then the current shift; DOWN before RIGHT."""
    rank = F.struct(
        F.abs(F.col("shift") - F.col(preferred)), F.abs(F.col("shift") - F.col(current)), F.when(F.col("mode") == "DOWN", 0).otherwise(1),
        F.col("delta_y"), F.col("delta_x"),
    )
    return candidates.groupBy(look).agg(F.min_by(F.struct("shift", "mode", "delta_y", "delta_x"), rank).alias("_best")).select(look, "_best.*")


def casefold_positions(names: DataFrame, name: str) -> DataFrame:
    """Distinct names with their place when sorted without case, then exactly; a null comes first.

    The names are dealt by range, so that names of one long common prefix spread as well as others; a range's
    number is its chunk, and the rows of the ranges before it are counted, not read again.
    """
    order = [F.lower(name), F.col(name)]
    ranged = names.select(name).distinct().repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    return number_rows(cut_lineage(ranged), [], F.col("_range"), order, "place").drop("_range")


def latest_runs(runs: DataFrame, identifier: str, limit: int, output: str | None = None, tail: int = 100_000) -> DataFrame:
    """The last runs by id in ascending order; long output keeps its end."""
    last = runs.orderBy(F.desc(identifier)).limit(limit).orderBy(identifier)
    return last if output is None else last.withColumn(output, F.right(F.col(output), F.lit(tail)))
