"""Integrity rules over keyed tables; each check returns violations, one row per key and rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Domains, limits and tolerances of the rules.
SHEETS = ["W", "M"]
ORIENTATION = "FULL_LEFT_CLOSE_RIGHT"
MIN_FILE_BYTES = 1024
MAX_SHIFT = 72
SHIFT_TOLERANCE, CROP_TOLERANCE, FRAME_TOLERANCE, MOVE_TOLERANCE = 0.01, 0.1, 0.5, 0.05
CONFIRMATION_NOTE, ORDER_NOTE = 25, 20
#: Copies of a row made at once.
ROWS_AT_ONCE = 10_000


def row_rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows breaking any rule, tested in one pass: keys and rule."""
    broken = [F.when(F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items()]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def repeated(df: DataFrame, unique: list[str], keys: list[str], rule: str) -> DataFrame:
    """Rows whose ``unique`` value is not theirs alone."""
    groups = df.groupBy(*unique).count().where("count > 1").drop("count")
    return df.join(groups, unique, "left_semi").select(*keys, F.lit(rule).alias("rule"))


def as_often(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, without that column; no array grows with the number."""
    begun = df.withColumn("_begun", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times).cast("bigint") - 1, F.lit(ROWS_AT_ONCE).cast("bigint"))))
    left = F.least(F.col(times) - F.col("_begun"), F.lit(ROWS_AT_ONCE)).cast("int")
    return begun.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), left))).drop("_begun", "_copy", times)


def absent(df: DataFrame, other: DataFrame, on: list[str], keys: list[str], rule: str) -> DataFrame:
    return df.join(other.select(*on), on, "left_anti").select(*keys, F.lit(rule).alias("rule"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def look_name(position: Column) -> Column:
    digits = position.cast("string")
    return F.concat(F.lit("LOOK_"), F.lpad(digits, F.greatest(F.lit(3), F.char_length(digits)), F.lit("0")))


def is_blank(*names: str) -> Column:
    condition = F.lit(False)
    for name in names:
        condition = condition | (F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == "")
    return condition


REGISTRY_FIELDS = ["look_id", "spread_order", "pdf_spread", "left_filename", "right_filename", "indd_left_page", "indd_right_page"]


def check_registry(registry: DataFrame, files: DataFrame, project: str = "project") -> DataFrame:
    """Rows must be dense in position, pair two different existing files and own their two pages."""
    keys, position = [project, "position"], F.col("position")
    rules = {
        "look id": F.col("look_id") != look_name(position),
        "blank field": is_blank(*REGISTRY_FIELDS),
        "spread order": (F.col("spread_order") != position) | (F.col("pdf_spread") != position),
        "same file twice": F.col("left_filename") == F.col("right_filename"),
        "pages": (F.col("indd_left_page") != position * 2) | (F.col("indd_right_page") != position * 2 + 1),
    }
    sides = registry.select(*keys, F.explode(F.array("left_filename", "right_filename")).alias("name"))
    pages = registry.select(*keys, F.explode(F.array("indd_left_page", "indd_right_page")).alias("page"))
    last = registry.groupBy(project).agg(F.max("position").alias("position"), F.count("*").alias("_rows"), F.count_distinct("position").alias("_places"))
    return union_all([
        row_rules(registry, keys, rules),
        absent(sides.where("name is not null"), files.select(project, "name"), [project, "name"], keys, "file missing"),
        repeated(registry, [project, "left_filename", "right_filename"], keys, "pair repeated"),
        repeated(pages, [project, "page"], keys, "page repeated"),
        last.where((F.col("position") != F.col("_rows")) | (F.col("_rows") != F.col("_places"))).select(*keys, F.lit("not dense").alias("rule")),
    ])


def check_captions(captions: DataFrame, looks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every field filled, every caption's look known, every look captioned."""
    return union_all([
        row_rules(captions, [key], {"blank field": is_blank(*fields)}),
        absent(captions.select(key).distinct(), looks, [key], [key], "unknown look"),
        absent(looks.select(key).distinct(), captions, [key], [key], "no rows"),
    ])


def check_caption_map(card_map: DataFrame, registry: DataFrame, files: DataFrame, manifest: DataFrame, project: str = "project") -> DataFrame:
    """Complete, unique, confirmed map whose files exist, are named for their card and are unchanged.

    ``files``: name, bytes, sha256.  ``manifest``: position, name, sha256 as bound when proven.
    """
    keys, on = [project, "position"], [project, "position"]
    number = F.col("excel_look_number").try_cast("bigint")
    digits = number.cast("string")
    prefix = F.concat("excel_sheet", F.lit("_"), F.lpad(digits, F.greatest(F.lit(3), F.char_length(digits)), F.lit("0")), F.lit("_"))
    pair = registry.select(*on, F.col("left_filename").alias("_left"), F.col("right_filename").alias("_right"))
    joined = card_map.join(pair, on, "left")
    rules = {
        "look id": F.col("look_id") != look_name(F.col("position")),
        "photo pair": ~F.col("left_filename").eqNullSafe(F.col("_left")) | ~F.col("right_filename").eqNullSafe(F.col("_right")),
        "card": ~F.col("excel_sheet").isin(SHEETS) | ~F.col("excel_look_number").rlike("^[0-9]+$") | (number <= 0),
        "not confirmed": ~F.col("visual_status").eqNullSafe(F.lit("CONFIRMED")),
        "image name": ~F.startswith("excel_image", prefix),
    }
    needed = card_map.select(*keys, F.explode(F.array("excel_image", "evidence_file")).alias("name"))
    sized = files.where(F.col("bytes") >= MIN_FILE_BYTES)
    bound = manifest.join(files.select(project, "name", F.col("sha256").alias("_now")), [project, "name"], "left")
    return union_all([
        row_rules(joined, keys, rules),
        repeated(card_map, [project, "excel_sheet", "excel_look_number"], keys, "card repeated"),
        absent(needed, sized, [project, "name"], keys, "file missing or too small"),
        bound.where(~F.col("sha256").eqNullSafe(F.col("_now"))).select(*keys, F.lit("evidence changed").alias("rule")),
    ])


def check_map_complete(card_map: DataFrame, project: str = "project") -> DataFrame:
    """The form of :func:`check_caption_map` used before captions are published."""
    keys = [project, "position"]
    rules = {
        "look id": F.col("look_id") != look_name(F.col("position")),
        "not confirmed": ~F.col("visual_status").eqNullSafe(F.lit("CONFIRMED")),
        "card": ~F.col("excel_sheet").isin(SHEETS) | ~F.col("excel_look_number").rlike("^[0-9]+$"),
    }
    return union_all([
        row_rules(card_map, keys, rules), repeated(card_map, [project, "excel_sheet", "excel_look_number"], keys, "card repeated")
    ])


def check_plan(plan: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Ready plan rows with the registry's two files in either order and a bounded shift."""
    pair = registry.select(*keys, F.sort_array(F.array("left_filename", "right_filename")).alias("_pair"))
    shift = F.col("photo_adjustment_points").try_cast("double")
    # Tested before the rows meet, so that only verdicts and the files travel; one join finds the missing plans too.
    own = {
        "orientation": F.col("orientation") != ORIENTATION,
        "not ready": F.col("plan_status") != "READY",
        "shift": shift.isNull() | F.isnan(shift) | (F.abs(shift) > MAX_SHIFT),
    }
    files = F.sort_array(F.array("left_image_filename", "right_image_filename")).alias("_files")
    tested = plan.select(*keys, files, *[rule.alias(name) for name, rule in own.items()], F.lit(True).alias("_planned"))
    rules = {name: F.col(name) for name in own}
    rules["photo pair"] = F.col("_planned") & ~F.col("_files").eqNullSafe(F.col("_pair"))
    rules["no plan"] = F.col("_planned").isNull()
    return row_rules(tested.join(pair, keys, "full_outer"), keys, rules)


def check_frame_moves(moves: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Frame moves from (from_*) to (to_*) bounds in top, left, bottom, right order.

    DOWN keeps the style and goes only down; RIGHT is right-aligned and never goes up.
    """
    dx, dy = F.col("to_left") - F.col("from_left"), F.col("to_top") - F.col("from_top")
    bounds = [F.col(f"{end}_{side}") for end in ("from", "to") for side in ("top", "left", "bottom", "right")]
    finite = F.lit(True)
    for bound in bounds:
        finite = finite & bound.isNotNull() & ~F.isnan(bound) & (F.abs(bound) < float("inf"))
    rules = {
        "mode": ~F.col("mode").isin("DOWN", "RIGHT"),
        "alignment": ((F.col("mode") == "DOWN") & (F.col("paragraph_alignment") != "STYLE"))
        | ((F.col("mode") == "RIGHT") & (F.col("paragraph_alignment") != "RIGHT_ALIGN")),
        "bounds": ~finite | (F.col("to_bottom") <= F.col("to_top")) | (F.col("to_right") <= F.col("to_left")),
        "direction": ((F.col("mode") == "DOWN") & ((F.abs(dx) > MOVE_TOLERANCE) | (dy <= MOVE_TOLERANCE)))
        | ((F.col("mode") == "RIGHT") & ((dx <= MOVE_TOLERANCE) | (dy < -MOVE_TOLERANCE))),
    }
    # Rules of the key alone need its counts, not its rows: nothing is sorted, and a hot key is added up before it travels.
    counted = moves.select(key, F.lit(1).alias("_moves"), F.lit(False).alias("_known")).unionByName(
        known.select(key, F.lit(0).alias("_moves"), F.lit(True).alias("_known"))
    ).groupBy(key).agg(F.sum("_moves").alias("_moves"), F.max("_known").alias("_known"))
    of_key = {
        "repeated": F.col(key).isNotNull() & (F.col("_moves") > 1),
        "unknown look": (F.col("_moves") > 0) & (F.col(key).isNull() | ~F.col("_known")),
    }
    return row_rules(moves, [key], rules).unionByName(as_often(row_rules(counted, [key, "_moves"], of_key), "_moves"))


def check_applied(planned: DataFrame, applied: DataFrame, keys: list[str]) -> DataFrame:
    """What was applied equals what was planned within the tolerances, with full coverage.

    planned: shift, left_file, right_file and optionally frame bounds; applied: the same plus
    crop bounds before and after in top, left, bottom, right order.
    """
    joined = planned.alias("p").join(applied.alias("a"), keys, "full_outer")
    p, a = (lambda name: F.col(f"p.{name}")), (lambda name: F.col(f"a.{name}"))
    missing, extra = a("shift").isNull(), p("shift").isNull()
    rules = {
        "not applied": missing,
        "not planned": extra,
        "files": (p("left_file") != a("left_file")) | (p("right_file") != a("right_file")),
        "recorded shift": F.abs(p("shift") - a("shift")) > SHIFT_TOLERANCE,
        "vertical change": (F.abs(a("before_top") - a("after_top")) > SHIFT_TOLERANCE) | (F.abs(a("before_bottom") - a("after_bottom")) > SHIFT_TOLERANCE),
        "crop shift": (F.abs(a("after_left") - a("before_left") - p("shift")) > CROP_TOLERANCE)
        | (F.abs(a("after_right") - a("before_right") - p("shift")) > CROP_TOLERANCE),
    }
    for side in ("top", "left", "bottom", "right"):
        if f"frame_{side}" in planned.columns:
            rules[f"frame {side}"] = F.abs(p(f"frame_{side}") - a(f"frame_{side}")) > FRAME_TOLERANCE
    return row_rules(joined, keys, rules)


def check_confirmations(items: DataFrame, confirmations: DataFrame, keys: list[str], hashes: list[str], note_length: int = CONFIRMATION_NOTE) -> DataFrame:
    """Exactly one confirmation per item, bound to its current hashes, with a long enough note."""
    times = confirmations.groupBy(*keys).agg(F.count("*").alias("_times"))
    bound = confirmations.select(*keys, "note", *[F.col(h).alias(f"_{h}") for h in hashes]).join(times, keys)
    joined = items.select(*keys, *hashes, F.lit(True).alias("_item")).join(bound, keys, "full_outer")
    differs = F.lit(False)
    for h in hashes:
        differs = differs | ~F.col(h).eqNullSafe(F.col(f"_{h}"))
    both = F.col("_item").isNotNull() & F.col("_times").isNotNull()
    return row_rules(joined, keys, {
        "not confirmed": F.col("_times").isNull(),
        "unknown item": F.col("_item").isNull(),
        "repeated": F.col("_times") > 1,
        "stale": both & differs,
        "short note": both & (F.char_length(F.trim(F.coalesce("note", F.lit("")))) < note_length),
    }).distinct()


def check_reference_manifest(manifest: DataFrame, registry: DataFrame, files: DataFrame, cover_pages: int, project: str = "project") -> DataFrame:
    """Manifest items equal the registry, hashes are current, pages run without gap after the cover."""
    on = [project, "look_id"]
    base = registry.select(*on, "pdf_spread", F.col("left_filename").alias("_left"), F.col("right_filename").alias("_right"), F.lit(True).alias("_known"))
    joined = base.join(manifest, on, "full_outer")
    both = F.col("_known").isNotNull() & F.col("reference_page").isNotNull()
    rules = {
        "no item": F.col("reference_page").isNull(),
        "unknown look": F.col("_known").isNull(),
        "page": both & (F.col("reference_page") != F.col("pdf_spread") + cover_pages),
        "photo pair": both & ((F.col("left_filename") != F.col("_left")) | (F.col("right_filename") != F.col("_right"))),
    }
    bound = manifest.select(
        *on, F.explode(F.array(F.struct(F.col("left_filename").alias("name"), F.col("left_sha256").alias("sha256")),
                               F.struct(F.col("right_filename").alias("name"), F.col("right_sha256").alias("sha256")))).alias("b")
    ).select(*on, F.col("b.name").alias("name"), F.col("b.sha256").alias("sha256"))
    changed = bound.join(files.select(project, "name", F.col("sha256").alias("_now")), [project, "name"], "left").where(
        ~F.col("sha256").eqNullSafe(F.col("_now"))
    )
    # Distinct pages within the range, as many as there are looks, cover the range without a gap.
    extent = manifest.groupBy(project).agg(F.min("reference_page").alias("lo"), F.max("reference_page").alias("hi"), F.count("*").alias("n"))
    gap = extent.where((F.col("lo") != cover_pages + 1) | (F.col("hi") != F.col("n") + cover_pages))
    return union_all([
        row_rules(joined, on, rules),
        changed.select(*on, F.lit("photo changed").alias("rule")),
        repeated(manifest, [project, "reference_page"], on, "page repeated"),
        gap.select(project, F.lit(None).cast("string").alias("look_id"), F.lit("page range").alias("rule")),
    ])


def check_overrides(credits: DataFrame, project: str = "project") -> DataFrame:
    """Manual cards have both parts, a numeric number and one owner, sheets compared without case."""
    keys = [project, "look_id"]
    filled = credits.where(~is_blank("excel_sheet", "excel_look_number")).select(
        *keys, F.lower(F.trim("excel_sheet")).alias("_sheet"), F.trim("excel_look_number").alias("_number")
    )
    return union_all([
        row_rules(credits, keys, {
            "incomplete": is_blank("excel_sheet", "excel_look_number"),
            "number": ~is_blank("excel_look_number") & ~F.trim("excel_look_number").rlike("^[0-9]+$"),
        }),
        repeated(filled, [project, "_sheet", "_number"], keys, "card repeated"),
    ])


def check_census(items: DataFrame, looks: DataFrame, project: str = "project") -> DataFrame:
    """Labelled page items: label in FRONT, BACK, LEFT, RIGHT, CREDITS, LEGAL; page, look_id, text, last_page, date_text."""
    pages = items.groupBy(project).agg(F.max("last_page").alias("last_page"), F.max("date_text").alias("date_text"))
    size = looks.groupBy(project).agg(F.count("*").alias("_looks"))
    totals = items.groupBy(project).agg(
        *[F.count(F.when(F.col("label") == label, 1)).alias(label) for label in ("FRONT", "BACK", "LEGAL")],
        F.count(F.when((F.col("label") == "FRONT") & (F.col("page") != 1), 1)).alias("_front_moved"),
        F.count(F.when((F.col("label") == "BACK") & (F.col("page") != F.col("last_page")), 1)).alias("_back_moved"),
        F.count(F.when((F.col("label") == "LEGAL") & (F.col("page") == F.col("last_page")) & F.contains("text", F.col("date_text")), 1)).alias("_legal"),
    )
    book = totals.join(pages, project).join(size, project).withColumn("look_id", F.lit(None).cast("string"))
    per_look = (
        looks.select(project, "look_id", F.explode(F.array(F.lit("LEFT"), F.lit("RIGHT"), F.lit("CREDITS"))).alias("label"))
        .join(items.groupBy(project, "look_id", "label").agg(F.count("*").alias("_n")), [project, "look_id", "label"], "left")
    )
    return union_all([
        row_rules(book, [project, "look_id"], {
            "page count": F.col("last_page") != F.col("_looks") * 2 + 2,
            "front": (F.col("FRONT") != 1) | (F.col("_front_moved") > 0),
            "back": (F.col("BACK") != 1) | (F.col("_back_moved") > 0),
            "legal": (F.col("LEGAL") != 1) | (F.col("_legal") != 1),
        }),
        per_look.where(F.coalesce("_n", F.lit(0)) != 1).select(project, "look_id", F.concat(F.lower("label"), F.lit(" item")).alias("rule")),
    ])
