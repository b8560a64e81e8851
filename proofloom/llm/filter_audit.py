"""Filter interaction audit: what each of a set of filters removes, alone and in every order.

A document fails some filters; the set of those is a bit mask, and counts per (part, mask) hold all that is asked.  For
a coalition of filters the removal game has the value v(S): how many documents fail at least one filter of S.

  * Steps: a filter that follows the filters P in an order removes v(P + filter) - v(P).
  * Shapley: the potential of Hart and Mas-Colell is 0 for the empty coalition, and
    P(S) = (v(S) + sum of P(S - i) over i in S) / |S|.  A filter's Shapley value is P(all) - P(all - filter).
    Kept as whole numbers here: |S|! P(S) = (|S| - 1)! v(S) + sum of (|S| - 1)! P(S - i).

Only narrow rows are shuffled (two hashes, an id, a mask, two labels), and only counts per part and mask are gathered
per part, at most 2^filters of them.

Defined cases: a null text counts as empty.  Texts are equal when two 64-bit hashes are.  A row without an id is no
copy of a smaller id and no original of another, and has no labels.  A row whose id and text are repeated is a copy only
of rows with a smaller id.  With several labels for one id, any 1 counts.  An empty table has no parts and so no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = r"[#$%&*|]"


def _text_filters() -> dict[str, Column]:
    """Failure conditions over the columns _text, _words, _distinct (counts of words)."""
    capitals = F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))
    return {
        "A": F.col("_words") < MIN_WORDS,
        "B": 100 * F.col("_distinct") < DISTINCT_PERCENT * F.col("_words"),
        "C": 100 * capitals > CAPITAL_PERCENT * F.length("_text"),
        "D": F.col("_text").rlike(SYMBOLS),
    }


#: The filters in the order of their bits; the last one is the filter for copies.
FILTERS = "ABCDE"


def filter_failures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: id, part ('' where null) and failed, the mask of the filters that it fails."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), plain.alias("_text"),
        F.xxhash64(plain).alias("_hash"), F.xxhash64(F.lit(1), plain).alias("_hash2"),
        # Rows without an id match nothing, so they may go anywhere.
        F.when(F.col(key).isNull(), 1 + F.spark_partition_id()).otherwise(0).alias("_spread"),
    )
    words = rows.withColumn("_all", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    counted = words.withColumns({"_words": F.size("_all"), "_distinct": F.size(F.array_distinct("_all"))})
    mask = reduce(add, [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(_text_filters().values())])
    masked = counted.select("id", "part", "_hash", "_hash2", "_spread", mask.alias("_mask"))
    firsts = rows.where(F.col("id").isNotNull()).groupBy("_hash", "_hash2").agg(F.min("id").alias("id")).withColumns({"_spread": F.lit(0), "_first": F.lit(True)})
    copy = F.col("id").isNotNull() & F.col("_first").isNull()
    joined = masked.join(firsts, ["_spread", "_hash", "_hash2", "id"], "left")
    return joined.select("id", "part", "_spread", (F.col("_mask") + F.when(copy, 1 << (len(FILTERS) - 1)).otherwise(0)).alias("failed"))


def failure_counts(failures: DataFrame, labels: DataFrame, *, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """Documents, good and toxic ones per part and mask."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max((F.col(good) == 1).cast("int")).alias("_good"), F.max((F.col(toxic) == 1).cast("int")).alias("_toxic")
    ).withColumn("_spread", F.lit(0))
    marked = failures.join(marks, ["_spread", "id"], "left")
    totals = {"documents": F.count("*"), "good": F.sum(F.coalesce("_good", F.lit(0))), "toxic": F.sum(F.coalesce("_toxic", F.lit(0)))}
    return marked.groupBy("part", "failed").agg(*[total.alias(name) for name, total in totals.items()])


def coalition_values(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part: total, and for each coalition (the index is its mask) how many documents, good and toxic ones it removes."""
    spread = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    names = ("documents", "good", "toxic")
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    sums = spread.groupBy("part", "coalition").agg(F.sum("documents").alias("total"), *[F.sum(F.when(hit, F.col(n)).otherwise(0)).alias(n) for n in names])
    gathered = sums.groupBy("part").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("coalition", *names))).alias("values"))
    return gathered.select("part", "total", *[F.col(f"values.{n}").alias(n) for n in names])


def scaled_potentials(values: Column, filters: str = FILTERS) -> Column:
    """|S|! times the potential of every coalition, from the array of coalition values."""

    def grown(held: Column, s: Column) -> Column:
        without = reduce(add, [F.when(s.bitwiseAND(1 << i) != 0, F.get(held, s - (1 << i))).otherwise(0) for i in range(len(filters))])
        return F.concat(held, F.array(F.factorial(F.bit_count(s) - 1) * F.get(values, s) + without))

    # A coalition follows all those with one filter less, so one pass over the masks is the recursion.
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << len(filters)) - 1)), F.array(F.lit(0).cast("bigint")), grown)


def audit_orders(values: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, order and step of ``coalition_values``; filters are named by one letter each."""
    n = len(filters)
    full = (1 << n) - 1
    place = [F.instr("filter_order", letter) for letter in filters]
    bits = lambda chosen: reduce(add, [F.when(chosen(at), 1 << i).otherwise(0) for i, at in enumerate(place)])
    steps = (
        values.withColumn("potential", scaled_potentials(F.col("documents"), filters))
        .withColumn("filter_order", F.explode(F.lit(["".join(order) for order in permutations(filters)])))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumns({"before": bits(lambda at: at < F.col("step")), "own": bits(lambda at: at == F.col("step"))})
    )
    gained = lambda name: F.get(name, F.col("before") + F.col("own")) - F.get(name, F.col("before"))
    removed = gained("documents")
    return steps.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("documents", F.col("before") + F.col("own"))).alias("kept"),
        removed.alias("removed"),
        (F.get("documents", F.col("own")) - removed).alias("redundant"),
        (F.get("documents", F.lit(full)) - F.get("documents", full - F.col("own"))).alias("unique_fails"),
        gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        # n! P(all) - n (n-1)! P(all - filter): the filter's removed, summed over all orders.
        (F.get("potential", F.lit(full)) - n * F.get("potential", full - F.col("own"))).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (times the number of orders)."""
    return audit_orders(coalition_values(failure_counts(filter_failures(docs), labels)))


def orders(filters: str = FILTERS) -> int:
    """What ``shapley`` is to be divided by for the mean over all orders."""
    return math.factorial(len(filters))
