"""Mixing sources to target weights with DataFrame functions only.

Tokens are summed per source, targets and repetition rates follow from the sums, and a document is emitted
floor(rate) times plus once more when a hash of its id, text and number among equal rows falls below the fraction.  Only one row per source is
ever gathered; the documents meet it in a broadcast join when the sources are few (counted first), else in a
shuffled join that the adaptive planner may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from ..plans.chunks import number_rows
from ..plans.lineage import cut_lineage
from .common import WORD

#: A source is repeated at most this often.
MAX_REPEATS = 3
#: Weights dealt to sources in code-point order.
WEIGHTS = (1, 2, 3)
#: Sources that may be broadcast.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    """Number of words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights 1, 2, 3, 1, ... for the sources in code-point order, null last (one row per source)."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    dealt = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", dealt.cast("double"))


def source_targets(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets and rates of weighted sources: rows with source_size and weight gain target and rate.

    Sharing out by weight, stopping each source at ``repeats`` times its size and sharing the excess again ends
    where target = min(repeats * size, level * weight) and the targets add up to all sizes.  The level follows
    from running sums over the sources by repeats * size / weight: the first position at which the rest, shared
    by weight, no longer passes that source's own stop.
    """
    by_stop = Window.orderBy("_stop", "_order").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ordered = (
        sizes.withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("_stop", F.col("_cap") / F.col("weight"))
        .withColumn("_order", F.struct(F.col("source").isNull(), "source"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_stop), F.lit(0.0)))
        .withColumn("_weighed", F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0)))
        .withColumn("_level", (F.sum("source_size").over(whole) - F.col("_capped")) / (F.sum("weight").over(whole) - F.col("_weighed")))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "_level"))).over(whole)["_level"])
    )
    target = F.least(F.col("_cap"), F.col("_level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(repeats)), F.col("target") / F.col("source_size"))).otherwise(F.lit(1.0))
    return (
        ordered.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn("rate", rate)
        .drop("_cap", "_stop", "_order", "_capped", "_weighed", "_level")
    )


def hash_share(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key's text and the seed: 52 bits of MD5, the same on every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def _alike(docs: DataFrame, key: Column, text: Column, source: Column) -> DataFrame:
    """doc_id, source, size, digest of the text and n: how many rows have them alike (written, so texts are read once)."""
    told = docs.select(key.alias("doc_id"), source.alias("source"), words_in(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
    return cut_lineage(told.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n")))


def _rates(alike: DataFrame, repeats: int) -> DataFrame:
    """source (as _source), source_size, target and rate of every source."""
    sources = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rates = cut_lineage(source_targets(cyclic_weights(sources, "source"), repeats))
    return broadcast_if_small(rates.withColumnRenamed("source", "_source").drop("weight"), BROADCAST_SOURCES)


def _copies(key: Column, digest: Column, number: Column, seed: str) -> Column:
    """Copies of a row: the whole part of its rate, and one more if its own draw falls below the fraction."""
    own = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), digest, number.cast("string"))
    return (F.floor("rate") + (hash_share(own, seed) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def mixing_plan(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", repeats: int = MAX_REPEATS, seed: str = "mix:"
) -> DataFrame:
    """One row per document: the key, its size, source_size, target, rate and how many copies the mix takes.

    A draw is seeded with the key, the text's digest and the row's number among those alike in both, so rows
    without a key and repeated rows draw apart.  A null text has size 0 and the digest of an empty one; a null
    source is a source of its own, after all others.  Documents of an empty source are kept once.  An empty
    table gives no rows.
    """
    alike = _alike(docs, F.col(key), F.col(text), F.col(source))
    rated = alike.join(_rates(alike, repeats), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    numbered = rated.withColumn("_number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return numbered.withColumn("copies", _copies(F.col("doc_id"), F.col("digest"), F.col("_number"), seed)).drop("_number", "digest", "n")


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", repeats: int = MAX_REPEATS, seed: str = "mix:") -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: each as often as the plan takes it.

    The rates are joined to the documents by source (one small row each), so texts are not shuffled, but for rows
    alike in key, source and text: those are written once and numbered in the order of the table, part by part.
    """
    held = F.col("doc")
    whole = docs.select(F.struct("*").alias("doc"))  # so that no column of theirs clashes with ours
    alike = _alike(whole, held[key], held[text], held[source])
    named = {"_key": held[key], "_from": held[source], "_digest": F.md5(F.coalesce(held[text], F.lit("")))}
    rows = whole.withColumns(named).withColumn("_alike", F.xxhash64(*named))
    repeated = alike.where("n > 1").select(F.xxhash64("doc_id", "source", "digest").alias("_alike")).distinct()
    single = rows.withColumn("_number", F.lit(1).cast("bigint"))
    if not repeated.isEmpty():
        repeated = broadcast_if_small(repeated)
        placed = rows.join(repeated, "_alike", "left_semi").withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
        numbered = number_rows(cut_lineage(placed), list(named), F.col("_part"), [F.col("_place")], "_number").drop("_part", "_place")
        single = single.join(repeated, "_alike", "left_anti").unionByName(numbered)
    rated = single.join(_rates(alike, repeats), F.col("_from").eqNullSafe(F.col("_source")))
    copies = F.array_repeat(F.lit(0), _copies(F.col("_key"), F.col("_digest"), F.col("_number"), seed))
    return rated.select("doc", F.explode(copies)).select("doc.*")
