"""Exact least-cost one-to-one assignment of targets to candidates within blocks.

Small blocks are solved whole, one task each.  A block whose cost matrix is too large for one
task is never gathered: every target first offers only its cheapest candidate, the connected
pieces of those offers are solved apart (by an auction where a matrix would be too large, and over many
tasks where the offers are too many for one), and only targets whose result is not yet proven optimal
offer more.  The proof is dual: with prices p >= 0 from the solver, a target that pays cost + p no
more than the cheapest candidate it has not offered cannot gain from any unseen candidate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import auction
from .components import connected_components
from .lineage import cut_lineage
from .neighbours import PARTS_PER_CORE, _stack, _standard, nearest

WHOLE_BLOCK_PAIRS = 2_000_000
#: Larger pieces are not solved as a matrix.
PIECE_PAIRS = 1_000_000
#: Pieces of fewer offers are solved many to a task, in buckets of about so many offers.
BUCKET_OFFERS = 50_000
FIRST_LIST = 16
#: Offers of a target in the first round.
FIRST_OFFERS = 8
SLACK = 1e-12
#: An auction rounds costs to a grid.
AUCTION_SLACK = 1e-9


def cheapest_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest augmenting paths over a dense matrix; infinity marks a pair not on offer.

    Returns the column of each row (-1 where none can be had) and what each row pays: its cost
    plus the price of its column, or infinity where rows compete for too few columns.
    """
    rows, columns = cost.shape
    if rows > columns:  # every column is taken, by the rows that make the total least
        taken, _ = cheapest_assignment(cost.T)
        holds = np.full(rows, -1)
        holds[taken[taken >= 0]] = np.flatnonzero(taken >= 0)
        return holds, np.full(rows, np.inf)
    pays, rebate = np.zeros(rows), np.zeros(columns)
    owner, holds = np.full(columns, -1), np.full(rows, -1)
    for start in range(rows):
        length, via = np.full(columns, np.inf), np.full(columns, -1)
        closed = np.zeros(columns, dtype=bool)
        visited, row, reached, end = [], start, 0.0, -1
        while end < 0:
            visited.append(row)
            step = reached + cost[row] - pays[row] - rebate
            shorter = ~closed & (step < length)
            length[shorter], via[shorter] = step[shorter], row
            open_length = np.where(closed, np.inf, length)
            column = int(open_length.argmin()) if columns else -1
            if column < 0 or not np.isfinite(open_length[column]):
                break
            reached = open_length[column]
            closed[column] = True
            if owner[column] < 0:
                end = column
            else:
                row = owner[column]
        if end < 0:
            continue
        for row in visited:
            pays[row] += reached - (length[holds[row]] if row != start else 0.0)
        rebate[closed] -= reached - length[closed]
        while True:
            row = via[end]
            owner[end] = row
            holds[row], end = end, holds[row]
            if row == start:
                break
    return holds, pays


def _solve_whole_blocks(targets: DataFrame, candidates: DataFrame, cost) -> DataFrame:
    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["block", "target", "candidate", "cost"])
        left, right = left.sort_values("target"), right.sort_values("candidate")
        costs = cost.matrix(_stack(left["vec"]), _stack(right["vec"])) if len(right) else np.empty((len(left), 0))
        held, _ = cheapest_assignment(costs)
        ids = right["candidate"].to_numpy()
        found = held >= 0
        return pd.DataFrame({
            "block": left["block"].to_numpy(), "target": left["target"].to_numpy(),
            "candidate": pd.array([int(ids[h]) if ok else None for h, ok in zip(held, found)], dtype="Int64"),
            "cost": [costs[i, h] if ok else None for i, (h, ok) in enumerate(zip(held, found))],
        })

    return (
        targets.groupBy("block").cogroup(candidates.groupBy("block"))
        .applyInPandas(solve, "block bigint, target bigint, candidate bigint, cost double")
    )


def _solve_piece(target: np.ndarray, candidate: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    """One connected piece of offers; a target that gets nothing has -1 as its place among the candidates."""
    targets, rows = np.unique(target, return_inverse=True)
    candidates, columns = np.unique(candidate, return_inverse=True)
    slack = SLACK
    if len(targets) * len(candidates) > PIECE_PAIRS:
        held, pays = auction.solve_offers(rows, columns, cost)
        slack = AUCTION_SLACK
    else:
        costs = np.full((len(targets), len(candidates)), np.inf)
        costs[rows, columns] = cost
        held, pays = cheapest_assignment(costs)
    paid, mine = np.full(len(targets), np.nan), held[rows] == columns
    paid[rows[mine]] = cost[mine]
    short = np.full(len(targets), (held < 0).any())
    return {"target": targets, "candidate": candidates[held], "served": held >= 0, "cost": paid, "pays": pays, "short": short, "slack": np.full(len(targets), slack)}


def _solve_pieces(offers: DataFrame) -> DataFrame:
    """Solve each connected piece of (piece, block, target, candidate, cost); ``slack`` is how exact ``pays`` is."""

    def solve(held: pd.DataFrame) -> pd.DataFrame:
        number = pd.factorize(held["piece"])[0]
        order = np.argsort(number, kind="stable")
        ends = np.flatnonzero(np.diff(number[order], append=-1)) + 1
        block, target, candidate, cost = (held[name].to_numpy()[order] for name in ("block", "target", "candidate", "cost"))
        starts = [0, *ends[:-1].tolist()]
        parts = [_solve_piece(target[start:end], candidate[start:end], cost[start:end]) for start, end in zip(starts, ends.tolist())]
        found = {name: np.concatenate([part[name] for part in parts]) for name in parts[0]}
        served = found.pop("served")
        blocks = np.repeat(block[starts], [len(part["target"]) for part in parts])
        missing = pd.array(found["candidate"], dtype="Int64")
        missing[~served] = pd.NA
        return pd.DataFrame({"block": blocks, **found, "candidate": missing, "cost": pd.Series(found["cost"], dtype=object).where(served, None)})

    def solved(some: DataFrame, group: str) -> DataFrame:
        return some.groupBy(group).applyInPandas(solve, "block bigint, target bigint, candidate bigint, cost double, pays double, short boolean, slack double")

    spark = offers.sparkSession
    offers = cut_lineage(offers)
    sizes = cut_lineage(offers.groupBy("piece").count().where(F.col("count") > BUCKET_OFFERS))
    # Pieces are few bytes and much work: a fixed number of parts, else they would be put together by their bytes.
    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    buckets = max(parts, offers.count() // BUCKET_OFFERS)
    bucketed = lambda some: solved(some.withColumn("_bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets))).repartition(parts, "_bucket"), "_bucket")
    if sizes.isEmpty():
        return bucketed(offers)
    large = sizes.where(F.col("count") > auction.TASK_OFFERS)
    alone = offers.join(sizes.where(F.col("count") <= auction.TASK_OFFERS), "piece", "left_semi").repartition(parts, "piece")
    every = bucketed(offers.join(sizes, "piece", "left_anti")).unionByName(solved(alone, "piece"))
    if large.isEmpty():
        return every
    auctioned = auction.auction(offers.join(large, "piece", "left_semi"))
    auctioned = auctioned.select("block", "target", "candidate", "cost", "pays", F.col("candidate").isNull().alias("short"), F.lit(AUCTION_SLACK).alias("slack"))
    return every.unionByName(auctioned)


def _solve_by_offers(targets: DataFrame, candidates: DataFrame, cost, pivots: int) -> DataFrame:
    held = candidates.groupBy("block").agg(F.count("*").alias("available"))
    columns = {"block": "block", "target": "target", "candidate": "candidate", "vector": "vec"}
    size = FIRST_LIST
    lists = cut_lineage(nearest(targets, candidates, cost, size, pivots=pivots, spread_ties=True, **columns))
    reveal = cut_lineage(targets.select("block", "target").join(held, "block").select("block", "target", F.least(F.lit(FIRST_OFFERS), "available").cast("int").alias("offers"), F.lit(size).alias("listed"), "available"))
    while True:
        shown = lists.join(reveal, ["block", "target"])
        offers = shown.where(F.col("rank") <= F.col("offers"))
        # Cost of the cheapest candidate not on offer, or a lower bound of it at the end of the list.
        unseen = shown.groupBy("block", "target").agg(
            F.min(F.when(F.col("rank") == F.col("offers") + 1, F.col("cost"))).alias("next_cost"),
            F.max("cost").alias("last_cost"), F.first("offers").alias("offers"), F.first("listed").alias("listed"), F.first("available").alias("available"),
        ).withColumn(
            "bound",
            F.when(F.col("offers") >= F.col("available"), F.lit(float("inf"))).otherwise(F.coalesce("next_cost", "last_cost")),
        )
        node = F.col("block").cast("string")
        edges = offers.withColumn("_t", F.concat(node, F.lit("t"), "target")).withColumn("_c", F.concat(node, F.lit("c"), "candidate"))
        pieces = connected_components(edges, "_t", "_c").select(F.col("node").alias("_t"), F.col("label").alias("piece"))
        solved = cut_lineage(_solve_pieces(edges.join(pieces, "_t").select("piece", "block", "target", "candidate", "cost")))
        judged = solved.join(unseen.select("block", "target", "bound", "offers", "available"), ["block", "target"])
        unproven = cut_lineage(
            judged.where((F.col("short") | (F.col("pays") > F.col("bound") + F.col("slack"))) & (F.col("offers") < F.col("available")))
            .select("block", "target", F.lit(True).alias("_grow"))
        )
        if unproven.isEmpty():
            return solved.select("block", "target", "candidate", "cost")
        more = F.when(F.col("_grow"), F.least(F.col("offers") * 2, F.col("available"))).otherwise(F.col("offers")).cast("int")
        reveal = cut_lineage(reveal.join(unproven, ["block", "target"], "left").withColumn("offers", more).drop("_grow"))
        needed = reveal.where(F.col("offers") > F.col("listed"))
        if not needed.isEmpty():
            size *= 2
            again = nearest(targets.join(needed.select("block", "target"), ["block", "target"], "left_semi"), candidates, cost, size, pivots=pivots, spread_ties=True, **columns)
            lists = cut_lineage(lists.join(needed, ["block", "target"], "left_anti").unionByName(again))
            reveal = cut_lineage(reveal.withColumn("listed", F.when(F.col("offers") > F.col("listed"), F.lit(size)).otherwise(F.col("listed"))))


class Turned:
    """A cost with the parts of target and candidate exchanged."""

    def __init__(self, cost):
        self.cost, self.metric, self.width = cost, cost.metric, getattr(cost, "width", 1)

    def matrix(self, targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        return self.cost.matrix(candidates, targets).T


def _solve_by_candidates(targets: DataFrame, candidates: DataFrame, cost, pivots: int) -> DataFrame:
    """Blocks with more targets than candidates: every candidate gets a target, the other targets none."""
    asking = candidates.withColumnRenamed("candidate", "target")
    offered = targets.withColumnRenamed("target", "candidate")
    served = _solve_by_offers(asking, offered, Turned(cost), pivots)
    served = served.select("block", F.col("candidate").alias("target"), F.col("target").alias("candidate"), "cost")
    return targets.select("block", "target").join(served, ["block", "target"], "left").select("block", "target", "candidate", "cost")


def assign_one_to_one(
    targets: DataFrame, candidates: DataFrame, cost, *, block: str, target: str, candidate: str, vector: str,
    whole_block_pairs: int = WHOLE_BLOCK_PAIRS, pivots: int = 16,
) -> DataFrame:
    """Least total cost with every candidate used at most once: block, target, candidate, cost.

    A target that cannot be served (more targets than candidates) has a null candidate.
    """
    left = _standard(targets, block, target, vector, "target")
    right = _standard(candidates, block, candidate, vector, "candidate")
    pairs = (
        left.groupBy("block").agg(F.count("*").alias("t"))
        .join(right.groupBy("block").agg(F.count("*").alias("c")), "block", "left")
        .withColumn("whole", F.col("t") * F.coalesce("c", F.lit(0)) <= whole_block_pairs)
    )
    large = cut_lineage(pairs.where(~F.col("whole")).select("block", (F.col("t") > F.col("c")).alias("short")))
    if large.isEmpty():
        return _solve_whole_blocks(left, right, cost)
    whole = _solve_whole_blocks(left.join(large, "block", "left_anti"), right.join(large, "block", "left_anti"), cost)
    for solve, blocks in ((_solve_by_offers, large.where("NOT short")), (_solve_by_candidates, large.where("short"))):
        if not blocks.isEmpty():
            whole = whole.unionByName(solve(left.join(blocks, "block", "left_semi"), right.join(blocks, "block", "left_semi"), cost, pivots))
    return whole
