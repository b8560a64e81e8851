"""Joins of the catalogue: expansion, exclusion, boards, fallbacks, upserts and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notes import parse_card_label, styling_text

PLACEHOLDER_PREFIX = "__missing_"  # names of deliberately empty photographs; a parameter of what tests for them


def expand_credits(card_map: DataFrame, products: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Products of every mapped card with their order columns, and map rows without any product."""
    return card_map.join(products, on), card_map.join(products.select(*on), on, "left_anti")


def without(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the left side that the right side does not use."""
    return rows.join(other.select(*on), on, "left_anti")


def untried(candidates: DataFrame, attempted: DataFrame, reserved: DataFrame, confirmed: DataFrame, look: list[str], card: list[str]) -> DataFrame:
    """Candidates not attempted for their look, not reserved and not confirmed elsewhere."""
    taken = reserved.select(*card).unionByName(confirmed.select(*card))
    return without(without(candidates, attempted, [*look, *card]), taken, card)


def canonical_number(number: Column) -> Column:
    """Digits without leading zeros; null when the text is no number."""
    return F.when(F.trim(number).rlike("^[0-9]+$"), F.trim(number)).try_cast("decimal(38,0)").cast("string")


def within_board(choices: DataFrame, board: DataFrame, look: list[str], labels: list[str]) -> DataFrame:
    """First of the label columns, in order, that names a card on the look's own board.

    ``board``: look, excel_sheet, excel_look_number.  Result: every choice with sheet and number
    (null when no label is on the board) and ``ambiguous`` when its board repeats a logical card.
    """
    cards = board.select(
        *look, F.upper(F.trim("excel_sheet")).alias("sheet"), canonical_number(F.col("excel_look_number")).alias("number"),
        F.col("excel_look_number").alias("_written"),
    )
    logical = cards.groupBy(*look, "sheet", "number").agg(F.count_distinct("_written").alias("_forms"))
    ambiguous = logical.where("_forms > 1").select(*look).distinct().withColumn("_twice", F.lit(True))
    named = choices.select(*look, F.posexplode(F.array(*[parse_card_label(F.col(name)) for name in labels])).alias("_order", "_card")).where(F.col("_card").isNotNull())
    hits = (
        named.select(*look, "_order", F.col("_card.sheet").alias("sheet"), canonical_number(F.col("_card.number")).alias("number"))
        .join(logical, [*look, "sheet", "number"], "left_semi")
        .groupBy(*look).agg(F.min_by(F.struct("sheet", "number"), "_order").alias("_hit"))
    )
    return (
        choices.join(hits, look, "left").join(ambiguous, look, "left")
        .withColumn("sheet", F.col("_hit.sheet")).withColumn("number", F.col("_hit.number"))
        .withColumn("ambiguous", F.coalesce("_twice", F.lit(False))).drop("_hit", "_twice")
    )


def visible_source(slots: DataFrame, references: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """File shown in each slot (keys, filename): the asset, or the reference photo of a placeholder.

    ``references``: keys, reference_path.  ``files``: name, path.  Adds source and missing.
    """
    base = F.regexp_extract("filename", r"([^/\\]*)$", 1)
    placeholder = F.startswith(F.lower(base), F.lit(PLACEHOLDER_PREFIX))
    joined = slots.join(references, keys, "left").join(files.select(F.col("name").alias("filename"), F.col("path").alias("_asset")), "filename", "left")
    source = F.when(placeholder, F.col("reference_path")).otherwise(F.col("_asset"))
    return joined.withColumn("source", source).withColumn("missing", F.col("source").isNull()).drop("reference_path", "_asset")


CREDIT_FIELDS = ["excel_sheet", "excel_look_number", "excel_image", "evidence_file", "visual_status"]


def merge_with_override(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Refresh credits without losing a manual choice the refresh did not take over.

    A kept manual row whose card differs stays as it is; the same card clears the flag.  Existing
    notes win over new ones, and rows missing from the refresh go unless they are manual.
    """
    old, new = existing.alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, keys, "full_outer")
    o, n = (lambda name: F.col(f"o.{name}")), (lambda name: F.col(f"n.{name}"))
    same = (F.lower(F.trim(o("excel_sheet"))) == F.lower(F.trim(n("excel_sheet")))) & (F.trim(o("excel_look_number")) == F.trim(n("excel_look_number")))
    manual = F.coalesce(o("manual_override"), F.lit(0)) != 0
    keep = manual & (n("_new").isNull() | ~F.coalesce(same, F.lit(False)))
    fields = [F.when(keep, o(name)).otherwise(n(name)).alias(name) for name in CREDIT_FIELDS]
    note = F.when(keep | (F.coalesce(o("note"), F.lit("")) != ""), o("note")).otherwise(n("note")).alias("note")
    return joined.where(keep | n("_new").isNotNull()).select(*keys, *fields, note, F.when(keep, o("manual_override")).otherwise(0).alias("manual_override"))


def overlay_groups(rows: DataFrame, replacement: DataFrame, key: str, position: str, sub_position: str) -> DataFrame:
    """Replace all rows of a key by new ones at the key's first position; other rows keep theirs.

    Order of the result: (position, sub_position).
    """
    first = rows.groupBy(key).agg(F.min(position).alias(position))
    fresh = replacement.drop(position) if position in replacement.columns else replacement
    kept = rows.join(replacement.select(key), key, "left_anti").withColumn(sub_position, F.lit(0).cast("bigint"))
    placed = fresh.join(first, key).withColumn(sub_position, F.col(sub_position).cast("bigint"))
    return kept.unionByName(placed.select(kept.columns))


def overlay_unknown(rows: DataFrame, replacement: DataFrame, key: str) -> DataFrame:
    """Keys to be replaced that the table does not have: an error of the caller."""
    return replacement.select(key).distinct().join(rows.select(key), key, "left_anti")


def overlay_by_key(baseline: DataFrame, changed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Changed keys take the new values, all other keys the reviewed baseline."""
    new = changed.select(*keys, F.struct(*values).alias("_new"))
    joined = baseline.join(new, keys, "left")
    picked = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name) for name in values]
    return joined.select(*keys, *picked, F.col("_new").isNotNull().alias("replaced"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, as ``missing`` (right lacks it) or ``extra``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        b.join(a, keys, "left_anti").withColumn("side", F.lit("extra"))
    )


def signature(*fields: str) -> Column:
    """Content signature of a row's named fields, blind to column order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def cache_lookup(requests: DataFrame, cache: DataFrame, inputs: list[str], result: str = "result") -> DataFrame:
    """Attach the cached result where the whole signature agrees and the stored result is intact.

    ``cache``: signature, result, result_sha256, status.  Rows with a null result are the misses.
    """
    sound = cache.where((F.col("status") == "completed") & (F.sha2(F.col(result), 256) == F.col("result_sha256")))
    one = sound.groupBy("signature").agg(F.max(result).alias(result))
    return requests.withColumn("signature", signature(*inputs)).join(one, "signature", "left")


def apply_manual(registry: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """Manual file pairs replace both files when both are given and differ.

    Adds ``applied`` and ``unresolved`` (still a placeholder on either side).
    """
    given = manual.select(*keys, F.col("left_filename").alias("_left"), F.col("right_filename").alias("_right"))
    filled = (F.coalesce("_left", F.lit("")) != "") & (F.coalesce("_right", F.lit("")) != "")
    applied = filled & (F.col("_left") != F.col("_right"))
    left, right = F.when(applied, F.col("_left")).otherwise(F.col("left_filename")), F.when(applied, F.col("_right")).otherwise(F.col("right_filename"))
    empty = F.startswith(F.lower("left_filename"), F.lit(PLACEHOLDER_PREFIX)) | F.startswith(F.lower("right_filename"), F.lit(PLACEHOLDER_PREFIX))
    return (
        registry.join(given, keys, "left").withColumn("applied", F.coalesce(applied, F.lit(False)))
        .withColumn("left_filename", left).withColumn("right_filename", right).withColumn("unresolved", empty).drop("_left", "_right")
    )


def styling_warning(rows: DataFrame, observations: DataFrame, keys: list[str], proof_hash: str) -> DataFrame:
    """Styling text of the observation made for exactly the confirmed card and proof, else null."""
    seen = observations.select(*keys, proof_hash, styling_text(F.col("description")).alias("_styling"))
    confirmed = F.col("visual_status") == "CONFIRMED"
    return rows.join(seen, [*keys, proof_hash], "left").withColumn("warning", F.when(confirmed, F.col("_styling"))).drop("_styling")
