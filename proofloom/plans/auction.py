"""Least-cost assignment over a table of offers too large for one task: a distributed auction with price scaling.

State is a table of candidates with price, holder and what the holder pays; nothing is gathered.  In a forward round every
target without a candidate bids for the one where cost + price is least, and raises its price by its lead over the second
best plus epsilon.  A task takes open targets, and the holders of what they want, lets them bid against each other, and hands
on one bid per target; a candidate goes to the highest bid, and its former holder is open again if it has no bid.  When all targets are placed, candidates
that nobody holds although their price is not zero bid for targets the same way (reverse rounds), until their price is
zero: then prices prove the assignment optimal up to epsilon per target.  Epsilon then shrinks, prices stay.

Costs are whole multiples of a grid, multiplied by the number of targets plus one, so an epsilon of one proves the optimum
of the gridded costs; rounds stop as soon as the gap between costs and prices proves it.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import delete_table, written_table

#: Offers that one task bids over.
TASK_OFFERS = 1_000_000
#: Each phase divides epsilon by this.
SCALING = 8
#: Bits of a whole cost, with the factor for the number of targets.
COST_BITS = 56


def bid_among(
    bidder: np.ndarray, item: np.ndarray, cost: np.ndarray, value: np.ndarray, held: np.ndarray, owes: np.ndarray, outside: int, epsilon: int
) -> list[tuple[int, int, int, int]]:
    """Where every bidder ends after those without an item have bid, and those who lost theirs in turn.

    Rows are offers, numbers from 0; ``value`` is the price of every item, ``held`` (-1: none) and ``owes`` what every bidder has
    and pays.  Result: (bidder, item, price of the item, what the bidder pays); item -1 where all offers cost the bidder about
    as much as staying outside.
    """
    order = np.argsort(bidder, kind="stable")
    item, cost = item[order], cost[order]
    ends = np.cumsum(np.bincount(bidder)).tolist()
    starts = [0, *ends[:-1]]
    value, pays = value.copy(), dict(enumerate(owes.tolist()))
    holder = {i: b for b, i in enumerate(held.tolist()) if i >= 0}
    left, out = deque(np.flatnonzero(held < 0).tolist()), []
    while left:
        b = left.popleft()
        items = item[starts[b] : ends[b]]
        totals = cost[starts[b] : ends[b]] + value[items]
        best = int(totals.argmin())
        first = int(totals[best])
        if first >= outside - epsilon:
            out.append((b, -1, 0, outside))
            continue
        totals[best] = outside
        gain = min(int(totals.min()) - first + epsilon, outside - first)
        won = int(items[best])
        value[won] += gain
        if won in holder:
            left.append(holder[won])
        holder[won], pays[b] = b, first + gain
    return out + [(b, won, int(value[won]), pays[b]) for won, b in holder.items()]


def _grid(bidders: int, least: float, most: float) -> tuple[int, float, int]:
    """Factor of whole costs, steps of the grid per unit of cost, and what staying outside costs: twice the range of costs."""
    factor, spread = bidders + 1, (most - least) or 1.0
    grid = float(2.0 ** np.floor(COST_BITS - np.log2(factor) - np.log2(spread)))
    return factor, grid, 2 * int(round(spread * grid) + 1) * factor


def _least_prices(bidder: np.ndarray, item: np.ndarray, cost: np.ndarray, held: np.ndarray, dear: int) -> np.ndarray:
    """The least prices that prove an optimal assignment: no bidder may find an item cheaper than its own."""
    own = np.full(len(held), dear)
    mine = held[bidder] == item
    own[bidder[mine]] = cost[mine]
    price = np.zeros(int(item.max()) + 1, dtype=np.int64)
    while True:
        before = price.copy()
        np.maximum.at(price, item, (own + np.where(held >= 0, before[held], 0))[bidder] - cost)
        if (price == before).all():
            return price


def solve_offers(bidder: np.ndarray, item: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The auction in one task: the item of every bidder (-1: none) and what it pays; memory grows with the offers.

    Bidders and items are numbered from 0 and every bidder has an offer.
    """
    bidders, items = int(bidder.max()) + 1, int(item.max()) + 1
    factor, grid, dear = _grid(bidders, cost.min(), cost.max())
    whole = np.round((cost - cost.min()) * grid).astype(np.int64) * factor
    value, held, owes = np.zeros(items, dtype=np.int64), np.full(bidders, -1), np.full(bidders, dear)
    epsilon = max(1, dear // (2 * SCALING))
    while True:
        for b, won, price, pays in bid_among(bidder, item, whole, value, held, owes, dear, epsilon):
            held[b], owes[b] = won, pays
            if won >= 0:
                value[won] = price
        holder = np.full(items, -1)
        holder[held[held >= 0]] = np.flatnonzero(held >= 0)
        asking = np.flatnonzero((holder >= 0) | (value > 0))  # items that nobody holds at a price bid, and evict others
        place = np.full(items, -1)
        place[asking] = np.arange(len(asking))
        some = place[item] >= 0
        if (holder[asking] < 0).any():
            for i, b, credit, debit in bid_among(place[item[some]], bidder[some], whole[some], -owes, holder[asking], -value[asking], 0, epsilon):
                value[asking[i]] = -debit
                if b >= 0:
                    held[b], owes[b] = asking[i], -credit
        least = np.full(bidders, dear)
        np.minimum.at(least, bidder, whole + value[item])
        paid = sum(owes.tolist()) - sum(value[held[held >= 0]].tolist())
        if epsilon == 1 or paid - sum(least.tolist()) + sum(value.tolist()) < factor:
            price = np.where(held >= 0, _least_prices(bidder, item, whole, held, dear)[held], 0)
            exact = np.full(bidders, np.inf)
            mine = held[bidder] == item
            exact[bidder[mine]] = cost[mine]
            return held, exact + price / (grid * factor)
        epsilon = max(1, epsilon // SCALING)
        held[owes > least + epsilon] = -1


def _neighbourhood(offers: DataFrame, whole: bool, opened: DataFrame, placed: DataFrame, bidder: str, item: str) -> tuple[DataFrame, int]:
    """Bidders of a round (block, bidder, held, owes) and the number of tasks: all if one task can take them; else those
    without an item, with the holders of what they may bid for, and so on, as far as one task can take them."""
    none = opened.select("block", bidder, F.lit(None).cast("bigint").alias("held"), F.lit(0).cast("bigint").alias("owes"))
    size = lambda some: offers.join(some, ["block", bidder], "left_semi").limit(TASK_OFFERS + 1).count()
    if whole:
        return none.unionByName(placed), 1
    if size(none) > TASK_OFFERS:
        return none, -(-offers.join(none, ["block", bidder], "left_semi").count() // TASK_OFFERS)
    members = none
    while True:
        wanted = offers.join(members, ["block", bidder], "left_semi").select("block", item).distinct()
        near = placed.join(wanted.withColumnRenamed(item, "held"), ["block", "held"], "left_semi").select("block", bidder, "held", "owes")
        wider, path = written_table(none.unionByName(near))
        if size(wider) > TASK_OFFERS or wider.count() == members.count():
            delete_table(offers.sparkSession, path)
            return members, 1
        members = wider


def _bids(offers: DataFrame, whole: bool, opened: DataFrame, placed: DataFrame, values: DataFrame, bidder: str, item: str, outside: int, epsilon: int) -> DataFrame:
    """block, bidder, item (null: stays outside), value, pays: one row per bidder of the round."""
    members, parts = _neighbourhood(offers, whole, opened, placed, bidder, item)

    def bid(group: pd.DataFrame) -> pd.DataFrame:
        # Offers of a bidder are tried in an order of its own, so that equal ones are spread over the items.
        group = group.iloc[np.argsort(group["spread"].to_numpy(), kind="stable")]
        bidders, named = pd.MultiIndex.from_arrays([group["block"], group[bidder]]).factorize()
        items, called = pd.MultiIndex.from_arrays([group["block"], group[item]]).factorize()
        value, held, owes = np.zeros(len(called), dtype=np.int64), np.full(len(named), -1), np.zeros(len(named), dtype=np.int64)
        value[items], owes[bidders] = group["value"], group["owes"]
        own = (group["held"] == group[item]).to_numpy(dtype=bool, na_value=False)
        held[bidders[own]] = items[own]
        found = bid_among(bidders, items, group["cost"].to_numpy(), value, held, owes, outside, epsilon)
        return pd.DataFrame({
            "block": [named[b][0] for b, *_ in found], bidder: [named[b][1] for b, *_ in found],
            item: pd.array([called[i][1] if i >= 0 else None for _, i, *_ in found], dtype="Int64"),
            "value": [v for *_, v, _ in found], "pays": [p for *_, p in found],
        })

    asked = offers.join(members, ["block", bidder]).join(values, ["block", item])
    group = (F.lit(0) if parts == 1 else F.pmod(F.xxhash64("block", bidder), F.lit(parts))).alias("_group")
    dealt = asked.select("block", bidder, item, "cost", "value", "held", "owes", F.xxhash64("block", bidder, item).alias("spread"), group)
    return written_table(dealt.groupBy("_group").applyInPandas(bid, f"block bigint, {bidder} bigint, {item} bigint, value bigint, pays bigint"))[0]


def _highest(bids: DataFrame, item: str, bidder: str) -> DataFrame:
    """The highest bid for every item, ties to the smaller bidder."""
    best = bids.where(F.col(item).isNotNull()).groupBy("block", item).agg(F.max(F.struct("value", (-F.col(bidder)).alias("id"), "pays")).alias("best"))
    return best.select("block", item, F.col("best.value").alias("_value"), (-F.col("best.id")).alias("_bidder"), F.col("best.pays").alias("_pays"))


class _State:
    """candidates: block, candidate, price, target, pays; outside: block, target."""

    def __init__(self, candidates: DataFrame, outside: DataFrame):
        self.paths: list[str] = []
        self.set(candidates, outside)

    def set(self, candidates: DataFrame, outside: DataFrame) -> None:
        (self.candidates, one), (self.outside, other) = written_table(candidates), written_table(outside)
        for path in self.paths:
            delete_table(candidates.sparkSession, path)
        self.paths = [one, other]

    def held(self, bidder: str, item: str, owes: Column) -> DataFrame:
        return self.candidates.where(F.col("target").isNotNull()).select("block", bidder, F.col(item).alias("held"), owes.alias("owes"))

    def placed(self) -> DataFrame:
        return self.candidates.where(F.col("target").isNotNull()).select("block", "target").unionByName(self.outside)


def _forward(offers: DataFrame, whole: bool, targets: DataFrame, state: _State, dear: int, epsilon: int) -> None:
    while True:
        opened, path = written_table(targets.join(state.placed(), ["block", "target"], "left_anti"))
        if opened.isEmpty():
            return delete_table(offers.sparkSession, path)
        values, placed = state.candidates.select("block", "candidate", F.col("price").alias("value")), state.held("target", "candidate", F.col("pays"))
        bids = _bids(offers, whole, opened, placed, values, "target", "candidate", dear, epsilon)
        won = state.candidates.join(_highest(bids, "candidate", "target"), ["block", "candidate"], "left")
        new = lambda of, old: F.when(F.col("_bidder").isNull(), F.col(old)).otherwise(F.col(of)).alias(old)
        state.set(
            won.select("block", "candidate", new("_value", "price"), new("_bidder", "target"), new("_pays", "pays")),
            state.outside.unionByName(bids.where(F.col("candidate").isNull()).select("block", "target")),
        )
        delete_table(offers.sparkSession, path)


def _reverse(offers: DataFrame, whole: bool, state: _State, dear: int, epsilon: int) -> None:
    while True:
        opened = state.candidates.where(F.col("target").isNull() & (F.col("price") > 0)).select("block", "candidate")
        if opened.isEmpty():
            return
        values = state.candidates.where(F.col("target").isNotNull()).select("block", "target", (-F.col("pays")).alias("value"))
        values = values.unionByName(state.outside.select("block", "target", F.lit(-dear).cast("bigint").alias("value")))
        bids = _bids(offers, whole, opened, state.held("candidate", "target", -F.col("price")), values, "candidate", "target", 0, epsilon)
        won = _highest(bids, "target", "candidate").select("block", "target", F.col("_bidder").alias("candidate"), (-F.col("_value")).alias("_pays"), (-F.col("_pays")).alias("_price"))
        takes = won.select("block", "candidate", F.col("target").alias("_target"), "_pays", "_price")
        gone = won.select("block", "target", F.lit(True).alias("_gone"))
        free = bids.where(F.col("target").isNull()).select("block", "candidate", F.lit(True).alias("_free"))
        joined = state.candidates.join(gone, ["block", "target"], "left").join(takes, ["block", "candidate"], "left").join(free, ["block", "candidate"], "left")
        keeps = F.col("_gone").isNull()
        state.set(
            joined.select(
                "block", "candidate", F.when(F.col("_free"), 0).otherwise(F.coalesce("_price", "price")).cast("bigint").alias("price"),
                F.coalesce("_target", F.when(keeps, F.col("target"))).alias("target"), F.coalesce("_pays", F.when(keeps, F.col("pays"))).alias("pays"),
            ),
            state.outside.join(won, ["block", "target"], "left_anti"),
        )


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column.cast("decimal(38,0)")), F.lit(0))


def auction(offers: DataFrame) -> DataFrame:
    """Least-cost assignment over offers (piece, block, target, candidate, cost), each pair once.

    Offers of different pieces share no target and no candidate.

    Result: block, target, candidate, cost, pays (cost plus price) for every target; a target that no offer serves has a
    null candidate and pays infinity.  As many targets as possible are served only if every target offers all candidates.
    """
    size = offers.agg(F.count_distinct("block", "target").alias("n"), F.max("cost").alias("most"), F.min("cost").alias("least")).first()
    least = size["least"] or 0.0
    factor, grid, dear = _grid(size["n"] or 0, least, size["most"] or 0.0)
    whole = F.round((F.col("cost") - F.lit(least)) * F.lit(grid)).cast("bigint") * factor
    offered, path = written_table(offers.select("piece", "block", "target", "candidate", whole.alias("cost"), F.col("cost").alias("exact")))
    whole_task = offered.count() <= TASK_OFFERS
    narrow, targets = offered.drop("piece", "exact"), offered.select("block", "target").distinct()
    nobody = F.lit(None).cast("bigint")
    state = _State(offered.select("block", "candidate").distinct().select("block", "candidate", F.lit(0).cast("bigint").alias("price"), nobody.alias("target"), nobody.alias("pays")), targets.limit(0))
    epsilon = max(1, dear // (2 * SCALING))
    while True:
        _forward(narrow, whole_task, targets, state, dear, epsilon)
        _reverse(narrow, whole_task, state, dear, epsilon)
        priced = narrow.join(state.candidates.select("block", "candidate", "price"), ["block", "candidate"])
        best, best_path = written_table(priced.groupBy("block", "target").agg(F.least(F.min(F.col("cost") + F.col("price")), F.lit(dear)).alias("_least")))
        held = state.candidates.where(F.col("target").isNotNull())
        paid = int(held.agg(_total(F.col("pays") - F.col("price"))).first()[0]) + dear * state.outside.count()
        proven = int(best.agg(_total(F.col("_least"))).first()[0]) - int(state.candidates.agg(_total(F.col("price"))).first()[0])
        if epsilon == 1 or paid - proven < factor:
            break
        epsilon = max(1, epsilon // SCALING)
        stays = state.candidates.join(best, ["block", "target"], "left").withColumn("_stays", F.col("pays") <= F.col("_least") + epsilon)
        kept = lambda name: F.when(F.col("_stays"), F.col(name)).alias(name)
        state.set(
            stays.select("block", "candidate", "price", kept("target"), kept("pays")),
            state.outside.join(best.where(F.col("_least") + epsilon >= dear), ["block", "target"], "left_semi"),
        )
        delete_table(offers.sparkSession, best_path)
    unscaled = lambda whole: F.col(whole) / F.lit(grid * factor)
    # Where everything is held, all prices of a piece may fall alike.
    floors = state.candidates.join(offered.select("piece", "block", "candidate").distinct(), ["block", "candidate"]).groupBy("piece").agg(F.min("price").alias("_floor"))
    served = held.join(offered.select("piece", "block", "target", "candidate", "exact"), ["block", "target", "candidate"]).join(floors, "piece")
    served = served.withColumn("price", F.col("price") - F.col("_floor")).select("block", "target", "candidate", F.col("exact").alias("cost"), (F.col("exact") + unscaled("price")).alias("pays"))
    out = state.outside.select("block", "target", nobody.alias("candidate"), F.lit(None).cast("double").alias("cost"), F.lit(float("inf")).alias("pays"))
    result, _ = written_table(served.unionByName(out))
    for used in (path, best_path, *state.paths):
        delete_table(offers.sparkSession, used)
    return result
