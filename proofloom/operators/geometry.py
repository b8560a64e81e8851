"""Page geometry: boxes, hidden draws, image ownership, fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from ..plans.lineage import cut_lineage

# Least overlap, rounding tolerance around a later draw, share that hides a draw.
EPSILON = 1e-6
OCCLUSION_TOLERANCE = 1.0
OCCLUSION_COVERAGE = 0.95
SIDES = ["left", "bottom", "right", "top"]
CELL = 64.0
#: Draws of a page that are judged in one row; larger pages are cut into cells.
ROW_DRAWS = 64


def affine_bounds(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> dict[str, Column]:
    """Bounding box of the unit square under the matrix, left, bottom, right, top."""
    zero = F.lit(0.0)
    return {
        "left": e + F.least(zero, a) + F.least(zero, c), "bottom": f + F.least(zero, b) + F.least(zero, d),
        "right": e + F.greatest(zero, a) + F.greatest(zero, c), "top": f + F.greatest(zero, b) + F.greatest(zero, d),
    }


def clip(box: dict[str, Column], page: dict[str, Column]) -> dict[str, Column]:
    return {
        "left": F.greatest(box["left"], page["left"]), "bottom": F.greatest(box["bottom"], page["bottom"]),
        "right": F.least(box["right"], page["right"]), "top": F.least(box["top"], page["top"]),
    }


def has_area(box: dict[str, Column]) -> Column:
    return (box["right"] - box["left"] > EPSILON) & (box["top"] - box["bottom"] > EPSILON)


def intersects_page(box: dict[str, Column], page: dict[str, Column]) -> Column:
    return has_area(clip(box, page))


def union_bounds(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around all regions of a key (top, left, bottom, right)."""
    return regions.groupBy(*keys).agg(F.min("top").alias("top"), F.min("left").alias("left"), F.max("bottom").alias("bottom"), F.max("right").alias("right"))


def fit_in_box(image_width: Column, image_height: Column, box_width: Column, box_height: Column, gutter: int) -> Column:
    """Largest centred size of an image in a box less its gutter, in whole units; null if none fits."""
    scale = F.least((box_width - 2 * gutter) / image_width, (box_height - 2 * gutter) / image_height)
    width, height = F.floor(image_width * scale), F.floor(image_height * scale)
    fits = (box_width > 2 * gutter) & (box_height > 2 * gutter) & (image_width > 0) & (image_height > 0)
    placed = F.struct(
        width.alias("width"), height.alias("height"), F.floor((box_width - width) / 2).alias("x_offset"), F.floor((box_height - height) / 2).alias("y_offset")
    )
    return F.when(fits, placed)


def covered_area(rectangles: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of each key's rectangles (left, bottom, right, top): keys, covered.

    A plane sweep: the distinct left and right edges cut a key into slabs; in a slab the rectangles that span it are taken
    from the bottom up, and each adds what lies above all before it.
    """
    edges = rectangles.select(*keys, F.explode(F.array("left", "right")).alias("_x")).distinct()
    slabs = edges.withColumn("_next", F.lead("_x").over(Window.partitionBy(*keys).orderBy("_x"))).where(F.col("_next").isNotNull())
    spanning = rectangles.join(slabs, keys).where((F.col("left") <= F.col("_x")) & (F.col("right") >= F.col("_next")))
    upward = Window.partitionBy(*keys, "_x").orderBy("bottom", "top").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("bottom", F.max("top").over(upward))  # greatest skips the null of the first
    added = spanning.withColumn("_added", F.greatest(F.col("top") - start, F.lit(0.0)) * (F.col("_next") - F.col("_x")))
    return added.groupBy(*keys).agg(F.sum("_added").alias("covered"))


def _box(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    return F.struct(*[column.alias(side) for side, column in affine_bounds(a, b, c, d, e, f).items()])


def _sides(box) -> dict[str, Column]:
    return {side: box[side] for side in SIDES}


def _area(box) -> Column:
    return (box["right"] - box["left"]) * (box["top"] - box["bottom"])


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def _covered(boxes: Column) -> Column:
    """Area of the union of an array of boxes in order of their bottoms, by the sweep of ``covered_area``."""

    def slab(left: Column, right: Column) -> Column:
        state = F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("sum"))

        def upward(s: Column, b: Column) -> Column:
            added = F.greatest(b["top"] - F.greatest(b["bottom"], s["top"]), F.lit(0.0))
            more = F.struct(F.greatest(s["top"], b["top"]).alias("top"), (s["sum"] + added).alias("sum"))
            return F.when((b["left"] <= left) & (b["right"] >= right), more).otherwise(s)

        return F.aggregate(boxes, state, upward, lambda s: s["sum"]) * (right - left)

    def swept(edges: Column) -> Column:
        slabs = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), slab)
        return F.aggregate(slabs, F.lit(0.0), lambda total, part: total + part)

    edges = F.concat(F.transform(boxes, lambda b: b["left"]), F.transform(boxes, lambda b: b["right"]))
    return _once(F.array_sort(F.array_distinct(edges)), swept)


def _shown_in_rows(draws: DataFrame, pages: DataFrame, page_key: str) -> DataFrame:
    """``drop_occluded`` with all draws of a page in one row, so that they are dealt once."""
    held = draws.groupBy(page_key).agg(F.collect_list(F.struct(*draws.columns)).alias("_draws"))
    paged = held.join(pages.select(page_key, F.struct(*SIDES).alias("_page")), page_key)
    sheet = _sides(F.col("_page"))

    def boxed(draw: Column) -> Column:
        raw = _sides(_box(*[draw[name] for name in "abcdef"]))
        grown = clip({side: raw[side] + (OCCLUSION_TOLERANCE if side in ("right", "top") else -OCCLUSION_TOLERANCE) for side in SIDES}, sheet)
        order = ["bottom", "left", "right", "top"]
        return F.struct(
            *[grown[side].alias(side) for side in order], F.struct(*[raw[side].alias(side) for side in SIDES]).alias("raw"),
            ((F.abs(draw["b"]) > EPSILON) | (F.abs(draw["c"]) > EPSILON)).alias("rotated"), draw.alias("draw"),
        )

    made = paged.withColumn("_boxes", F.transform("_draws", boxed)).drop("_draws")
    made = made.withColumn("_turned", F.array_max(F.transform(F.filter("_boxes", lambda b: b["rotated"]), lambda b: b["draw"]["z"])))
    on_page = F.filter("_boxes", lambda b: intersects_page(_sides(b["raw"]), sheet))
    # Sorted by their bottoms, as the sweep needs them.
    made = made.withColumn("_over", F.array_sort(F.transform(
        F.filter("_boxes", lambda b: has_area(_sides(b))), lambda b: F.struct(b["bottom"].alias("bottom"), b["left"].alias("left"), b["right"].alias("right"), b["top"].alias("top"), b["draw"]["z"].alias("z")))))
    made = made.withColumn("_on_page", on_page).drop("_boxes")
    rows = made.select("_page", "_turned", "_over", F.explode("_on_page").alias("_one"))

    def hidden(own: Column) -> Column:
        def shared(box: Column) -> Column:
            return F.struct(*[column.alias(side) for side, column in clip(_sides(box), _sides(own)).items()])

        def enough(over: Column) -> Column:
            least = OCCLUSION_COVERAGE * _area(own)
            # What all of them together could cover is told first; the sweep follows only where that is enough.
            most = F.aggregate(over, F.lit(0.0), lambda total, b: total + _area(b))
            return F.when(most < least, F.lit(False)).otherwise(_covered(over) >= least)

        meets = lambda b: (b["z"] > own["z"]) & (b["left"] < own["right"]) & (b["right"] > own["left"]) & (b["bottom"] < own["top"]) & (b["top"] > own["bottom"])
        return _once(F.transform(F.filter("_over", meets), shared), enough)

    judged = ~F.col("_one.rotated") & (F.col("_turned").isNull() | (F.col("_one.draw.z") > F.col("_turned")))
    shown = clip(_sides(F.col("_one.raw")), _sides(F.col("_page")))
    own = F.struct(*[shown[side].alias(side) for side in SIDES], F.col("_one.draw.z").alias("z"))
    return rows.where(~F.when(judged, _once(own, hidden)).otherwise(F.lit(False))).select("_one.draw.*")


def drop_occluded(draws: DataFrame, pages: DataFrame, page_key: str = "page_id", cell: float = CELL, row_draws: int = ROW_DRAWS) -> DataFrame:
    """Draws that show on their page: those that touch it and are not hidden by later ones.

    ``draws``: page_key, z, a..f.  ``pages``: page_key, left, bottom, right, top.  A draw is hidden
    when later draws, each widened by a point, cover 95 % of its part of the page; it stays if it
    or any later draw is rotated or skewed.

    Draws of a page with up to ``row_draws`` of them meet in one row; those of larger pages meet in cells.
    """
    draws = cut_lineage(draws)
    large = cut_lineage(draws.groupBy(page_key).count().where(F.col("count") > row_draws).select(page_key))
    if large.isEmpty():
        return _shown_in_rows(draws, pages, page_key)
    large = broadcast_if_small(large)
    small = _shown_in_rows(draws.join(large, page_key, "left_anti"), pages, page_key)
    return small.unionByName(_shown_in_cells(draws.join(large, page_key, "left_semi"), pages, page_key, cell))


def _shown_in_cells(draws: DataFrame, pages: DataFrame, page_key: str, cell: float) -> DataFrame:
    """``drop_occluded`` for pages of any number of draws.

    Pages are cut into cells.  In a cell the latest draw that fills it hides everything before it
    there, so only the few draws after that one meet, however many are stacked; a sweep adds up what they cover.
    """
    sheet = {side: F.col(f"page_{side}") for side in SIDES}
    paged = draws.join(pages.select(page_key, *[F.col(side).alias(f"page_{side}") for side in SIDES]), page_key)
    box = affine_bounds(*[F.col(name) for name in "abcdef"])
    paged = paged.withColumn("rotated", (F.abs("b") > EPSILON) | (F.abs("c") > EPSILON))
    for side in SIDES:
        paged = paged.withColumn(side, box[side])
    paged = cut_lineage(paged)
    raw = {side: F.col(side) for side in SIDES}
    visible = clip(raw, sheet)
    grown = clip(
        {"left": raw["left"] - OCCLUSION_TOLERANCE, "bottom": raw["bottom"] - OCCLUSION_TOLERANCE,
         "right": raw["right"] + OCCLUSION_TOLERANCE, "top": raw["top"] + OCCLUSION_TOLERANCE}, sheet
    )
    edges = [f"page_{side}" for side in SIDES]
    on_page = paged.where(intersects_page(raw, sheet))
    last_rotated = paged.where("rotated").groupBy(page_key).agg(F.max("z").alias("_last_rotated"))
    candidates = (
        on_page.join(last_rotated, page_key, "left")
        .where(~F.col("rotated") & (F.col("_last_rotated").isNull() | (F.col("z") > F.col("_last_rotated"))))
        .select(page_key, "z", *[visible[side].alias(side) for side in SIDES], *edges)
    )
    # Equal boxes hide alike: only the latest of them matters.
    occluders = (
        paged.where(has_area(grown)).select(page_key, "z", *[grown[side].alias(side) for side in SIDES], *edges)
        .groupBy(page_key, *SIDES, *edges).agg(F.max("z").alias("z"))
    )

    def in_cells(df: DataFrame) -> DataFrame:
        steps = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.ceil(F.col(high) / cell) - 1)
        spread = df.withColumn("cx", F.explode(steps("left", "right"))).withColumn("cy", F.explode(steps("bottom", "top")))
        square = {"left": F.col("cx") * cell, "bottom": F.col("cy") * cell, "right": (F.col("cx") + 1) * cell, "top": (F.col("cy") + 1) * cell}
        part = clip({side: F.col(side) for side in SIDES}, square)
        shown_square = clip(square, sheet)
        full = F.lit(True)
        for side in SIDES:
            full = full & (part[side] == shown_square[side])
        return spread.select(page_key, "z", "cx", "cy", *[part[side].alias(side) for side in SIDES], full.alias("full")).where(
            (F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom"))
        )

    place, piece = [page_key, "cx", "cy"], (F.col("right") - F.col("left")) * (F.col("top") - F.col("bottom"))
    shades, parts = cut_lineage(in_cells(occluders)), in_cells(candidates).drop("full").withColumn("piece", piece)
    tops = shades.groupBy(*place).agg(F.max("z").alias("_latest"), F.max(F.when(F.col("full"), F.col("z"))).alias("_fill"))
    whole = Window.partitionBy(page_key, "z")
    under = lambda top: F.coalesce(F.sum(F.when(F.col("z") < F.col(top), F.col("piece"))).over(whole), F.lit(0.0))
    marked = parts.join(tops, place, "left").withColumns({"_enough": OCCLUSION_COVERAGE * F.sum("piece").over(whole), "_reach": under("_latest"), "_filled": under("_fill")})
    # A draw can only be hidden if later draws reach into cells that hold 95 % of it, and is if they fill such cells.
    reached = cut_lineage(marked.where(F.col("_reach") >= F.col("_enough")))
    beneath = F.coalesce(F.col("z") < F.col("_fill"), F.lit(False))
    doubtful = reached.where((F.col("_filled") < F.col("_enough")) & ~beneath & (F.col("z") < F.col("_latest")))
    over = shades.where("not full").select(*place, F.col("z").alias("_z"), *[F.col(side).alias(f"_{side}") for side in SIDES])
    met = doubtful.join(over, place).where(F.col("_z") > F.col("z"))
    shared = {"left": F.greatest("left", "_left"), "bottom": F.greatest("bottom", "_bottom"), "right": F.least("right", "_right"), "top": F.least("top", "_top")}
    overlaps = met.select(*place, "z", *[column.alias(side) for side, column in shared.items()]).where((F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom"))).distinct()
    partly = covered_area(overlaps, [*place, "z"]).groupBy(page_key, "z").agg(F.sum("covered").alias("_partly"))
    judged = reached.groupBy(page_key, "z").agg(F.first("_enough").alias("_enough"), F.first("_filled").alias("_filled")).join(partly, [page_key, "z"], "left")
    hidden = judged.where(F.col("_filled") + F.coalesce("_partly", F.lit(0.0)) >= F.col("_enough")).select(page_key, "z")
    return on_page.select(*draws.columns).join(hidden, [page_key, "z"], "left_anti")


def image_owner(images: DataFrame, areas: DataFrame, numbers: DataFrame, keys: list[str], bucket: int = 256, widen: int = 2) -> DataFrame:
    """The one look number an image in rows [start, end] belongs to; null owner unless exactly one.

    ``areas``: keys, first, last, number (merged cells).  ``numbers``: keys, row, number.  Hits are
    areas that overlap the rows and numbers inside them; only without any, numbers up to two rows
    further count.  Ranges meet in buckets of rows, never in a plain range join.
    """
    identity = [*keys, "image", "start", "end"]
    spans = areas.select(*keys, F.col("first").alias("lo"), F.col("last").alias("hi"), "number").unionByName(
        numbers.select(*keys, F.col("row").alias("lo"), F.col("row").alias("hi"), "number")
    )

    def bucketed(df: DataFrame, low: Column, high: Column) -> DataFrame:
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))))

    def hits(rows: DataFrame, others: DataFrame, reach: int) -> DataFrame:
        low, high = F.col("start") - reach, F.col("end") + reach
        near = bucketed(rows.select(*identity), low, high).join(bucketed(others, F.col("lo"), F.col("hi")), [*keys, "_bucket"])
        return near.where((F.col("lo") <= high) & (low <= F.col("hi"))).groupBy(*identity).agg(
            F.count_distinct("number").alias("found"), F.min("number").alias("number")
        )

    direct = hits(images, spans, 0)
    alone = images.join(direct, identity, "left_anti")
    rows_only = numbers.select(*keys, F.col("row").alias("lo"), F.col("row").alias("hi"), "number")
    every = direct.unionByName(hits(alone, rows_only, widen))
    return images.join(every, identity, "left").select(
        *identity, F.when(F.col("found") == 1, F.col("number")).alias("owner"), F.coalesce("found", F.lit(0)).alias("found")
    )
