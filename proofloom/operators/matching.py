"""Match confidence, joint pair decisions, quarantine of doubtful looks, page order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import PageSignature
from ..plans.assignment import assign_one_to_one
from ..plans.lineage import cut_lineage
from ..plans.neighbours import nearest, rank_of

# Limits on the score and on the gap between the two best candidates.
PHOTO_SCORE_LIMIT, PHOTO_MARGIN = 0.145, 0.004
CARD_SCORE_LIMIT, CARD_MARGIN = 0.155, 0.0045
PAIR_SCORE_LIMIT, PAIR_MARGIN = 0.32, 0.004
PAGE_BITS_LIMIT, PAGE_TONE_LIMIT, PAGE_REORDER_MARGIN = 512, 30.0, 96
SCORE_DIGITS = 7


def best_two(lists: DataFrame) -> DataFrame:
    """Best and second cost per target from ranked candidates."""
    return lists.where(F.col("rank") <= 2).groupBy("block", "target").agg(
        F.min("cost").alias("best_score"), F.min(F.when(F.col("rank") == 2, F.col("cost"))).alias("second_score")
    )


def rank_margin(
    selected: DataFrame, ranks: DataFrame, lists: DataFrame, score_limit: float, margin_limit: float, rounded: bool = False
) -> DataFrame:
    """Rank, best, second and margin of each selected (block, target, candidate, cost).

    ``needs_review`` where there is no selection, or it is not first, scores above the limit or
    leads by less than the margin.  ``rounded`` tests the values after rounding to seven digits.
    """
    joined = selected.join(ranks, ["block", "target"], "left").join(best_two(lists), ["block", "target"], "left")
    margin = F.coalesce(F.col("second_score") - F.col("best_score"), F.lit(float("inf")))

    def tested(value: Column) -> Column:
        return F.round(value, SCORE_DIGITS) if rounded else value

    doubtful = F.col("candidate").isNull() | (F.col("rank") != 1) | (tested(F.col("cost")) > score_limit) | (tested(margin) < margin_limit)
    return joined.select(
        "block", "target", "candidate", F.round("cost", SCORE_DIGITS).alias("selected_score"),
        F.round("best_score", SCORE_DIGITS).alias("best_score"), F.round("second_score", SCORE_DIGITS).alias("second_score"),
        "rank", F.round(margin, SCORE_DIGITS).alias("margin"), doubtful.alias("needs_review"),
    )


def match_one_to_one(
    targets: DataFrame, candidates: DataFrame, cost, score_limit: float, margin_limit: float, *, rounded: bool = False, **columns
) -> DataFrame:
    """Assignment with the confidence of every match."""
    assigned = cut_lineage(assign_one_to_one(targets, candidates, cost, **columns))
    lists = nearest(targets, candidates, cost, 2, **columns)
    block, target = columns["block"], columns["target"]
    selected = assigned.where(F.col("candidate").isNotNull()).select(
        F.col("block").alias(block), F.col("target").alias(target), F.col("candidate").alias("_selected"), F.col("cost").alias("_cost")
    )
    named = targets.select(block, target, columns["vector"]).join(selected, [block, target])
    ranks = rank_of(named, candidates, cost, named_cost="_cost", named_id="_selected", **columns)
    return rank_margin(assigned, ranks, lists, score_limit, margin_limit, rounded)


def pair_decisive(selected: DataFrame, lists: DataFrame, score_limit: float = PAIR_SCORE_LIMIT, margin: float = PAIR_MARGIN) -> DataFrame:
    """Looks whose selected (left, right) pair clearly beats every other pair of distinct candidates.

    Target ``2 * look`` is the left photo and ``2 * look + 1`` the right one.  The best and the
    second best pair lie among the three nearest of each side, so ``lists`` needs ranks 1 to 3.
    """
    look = F.floor(F.col("target") / 2).cast("bigint").alias("look")
    near = lists.where(F.col("rank") <= 3).select("block", look, (F.col("target") % 2).alias("side"), "candidate", "cost")
    left = near.where("side = 0").select("block", "look", F.col("candidate").alias("left"), F.col("cost").alias("left_cost"))
    right = near.where("side = 1").select("block", "look", F.col("candidate").alias("right"), F.col("cost").alias("right_cost"))
    order = Window.partitionBy("block", "look").orderBy("score", "left", "right")
    pairs = (
        left.join(right, ["block", "look"]).where(F.col("left") != F.col("right"))
        .withColumn("score", F.col("left_cost") + F.col("right_cost"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    )
    ranked = pairs.groupBy("block", "look").agg(
        F.min(F.when(F.col("rank") == 1, F.struct("left", "right", "score"))).alias("best"),
        F.coalesce(F.min(F.when(F.col("rank") == 2, F.col("score"))), F.lit(float("inf"))).alias("second"),
    )
    chosen = selected.groupBy("block", look).agg(
        F.min(F.when(F.col("target") % 2 == 0, F.col("candidate"))).alias("left"),
        F.min(F.when(F.col("target") % 2 == 1, F.col("candidate"))).alias("right"),
    )
    return (
        chosen.join(ranked, ["block", "look"])
        .where(
            (F.col("left") == F.col("best.left")) & (F.col("right") == F.col("best.right"))
            & (F.col("best.score") <= score_limit) & (F.col("second") - F.col("best.score") >= margin)
        )
        .select("block", "look", F.col("best.score").alias("pair_score"), (F.col("second") - F.col("best.score")).alias("pair_margin"))
    )


def _looks_beyond_supply(lists: DataFrame, targets: DataFrame, supply: DataFrame) -> DataFrame:
    """Looks to drop, worst supported first, until no block has more targets than candidates."""
    look = F.floor(F.col("target") / 2).cast("bigint").alias("look")
    support = (
        targets.join(lists.where("rank = 1").select("block", "target", "cost"), ["block", "target"], "left")
        .groupBy("block", look).agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("worst"), F.count("*").alias("photos"))
    )
    order = Window.partitionBy("block").orderBy(F.desc("worst"), "look")
    demand = targets.groupBy("block").agg(F.count("*").alias("wanted")).join(supply, "block", "left")
    short = demand.where(F.col("wanted") > F.coalesce("available", F.lit(0)))
    dropped_before = F.coalesce(F.sum("photos").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        support.join(short, "block").withColumn("dropped_before", dropped_before)
        .where(F.col("wanted") - F.col("dropped_before") > F.coalesce("available", F.lit(0))).select("block", "look")
    )


def quarantine_assign(
    targets: DataFrame, candidates: DataFrame, cost, *, score_limit: float = PHOTO_SCORE_LIMIT, margin_limit: float = PHOTO_MARGIN,
    pair_limit: float = PAIR_SCORE_LIMIT, pair_margin: float = PAIR_MARGIN, **columns,
) -> DataFrame:
    """One-to-one matches of whole looks; doubtful looks are set aside and the rest matched again.

    Result: block, target, candidate (null for a look set aside).  Stops when no look is newly
    doubtful; every round removes at least one look of some block.
    """
    block, target = columns["block"], columns["target"]
    look = F.floor(F.col("target") / 2).cast("bigint").alias("look")
    everyone = targets.withColumn("_look", F.floor(F.col(target) / 2).cast("bigint"))
    ids = cut_lineage(targets.select(F.col(block).cast("bigint").alias("block"), F.col(target).cast("bigint").alias("target")))
    lists = cut_lineage(nearest(targets, candidates, cost, 3, **columns))
    supply = candidates.groupBy(F.col(block).cast("bigint").alias("block")).agg(F.count("*").alias("available"))
    missing = cut_lineage(_looks_beyond_supply(lists, ids, supply))
    while True:
        aside = missing.select(F.col("block").alias("_block"), F.col("look").alias("_look"))
        active = everyone.join(aside, (F.col(block) == F.col("_block")) & (everyone["_look"] == aside["_look"]), "left_anti").drop("_look")
        assigned = cut_lineage(assign_one_to_one(active, candidates, cost, **columns))
        placed = lists.select("block", "target", "candidate", "rank")
        # A match outside the three nearest is not first, whatever its exact rank.
        ranks = assigned.join(placed, ["block", "target", "candidate"], "left").select("block", "target", F.coalesce("rank", F.lit(4)).alias("rank"))
        judged = rank_margin(assigned, ranks, lists, score_limit, margin_limit)
        decisive = pair_decisive(assigned, lists, pair_limit, pair_margin)
        doubtful = cut_lineage(
            judged.where("needs_review").select("block", look).distinct().join(decisive, ["block", "look"], "left_anti")
        )
        if doubtful.isEmpty():
            return ids.join(assigned.select("block", "target", "candidate"), ["block", "target"], "left")
        missing = cut_lineage(missing.unionByName(doubtful))


def nearest_pages(
    exported: DataFrame, expected: DataFrame, bits: int, tones: int, *, bits_limit: int = PAGE_BITS_LIMIT,
    tone_limit: float = PAGE_TONE_LIMIT, reorder_margin: int = PAGE_REORDER_MARGIN, **columns,
) -> DataFrame:
    """Every exported page against the expected page of its own number and the nearest one.

    ``mismatch`` where the own page differs too much, ``reorder`` where another page is clearly
    nearer, else ``match``.
    """
    cost = PageSignature(bits, tones)
    near = nearest(exported, expected, cost, 1, **columns)
    own = (
        exported.select(F.col(columns["block"]).cast("bigint").alias("block"), F.col(columns["target"]).cast("bigint").alias("page"), F.col(columns["vector"]).alias("_a"))
        .join(
            expected.select(F.col(columns["block"]).cast("bigint").alias("block"), F.col(columns["candidate"]).cast("bigint").alias("page"), F.col(columns["vector"]).alias("_b")),
            ["block", "page"],
        )
    )
    gap = F.zip_with("_a", "_b", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    measured = own.withColumn("_gap", gap).select(
        "block", "page", total(F.slice("_gap", 1, bits)).cast("int").alias("bits"), (total(F.slice("_gap", bits + 1, tones)) / tones).alias("tone")
    )
    nearest_bits = F.floor(F.col("cost") / PageSignature.BIT).cast("int")
    verdict = (
        F.when((F.col("bits") > bits_limit) | (F.col("tone") > tone_limit), "mismatch")
        .when((F.col("nearest_page") != F.col("page")) & (F.col("nearest_bits") + reorder_margin < F.col("bits")), "reorder")
        .otherwise("match")
    )
    return (
        measured.join(near.select("block", F.col("target").alias("page"), F.col("candidate").alias("nearest_page"), nearest_bits.alias("nearest_bits")), ["block", "page"])
        .withColumn("tone", F.round("tone", 3)).withColumn("verdict", verdict)
    )


def eval_ranking(ranks: DataFrame, group: str, top: int = 4) -> DataFrame:
    """Search quality per group: cases, how many expected cards are in the first page, reciprocal rank."""
    return ranks.groupBy(group).agg(
        F.count("*").alias("cases"), F.count(F.when(F.col("rank") <= top, 1)).alias("in_top"),
        F.round(F.avg(1 / F.col("rank")), 6).alias("mean_reciprocal_rank"),
    )
