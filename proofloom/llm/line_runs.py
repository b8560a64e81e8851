"""Line dedup by levelled sorted runs: lines that many documents hold go from all of them.

The state is a set of runs: tables of line hashes, bucketed and sorted by the hash, each row with the documents of its
run that hold the line and the documents up to then.  A batch of documents
  * counts its lines, is dealt into the same buckets, and is merge-joined with the runs, which need no shuffle for it;
  * drops, as an anti-join, the lines that the runs already hold in ``min_docs`` documents (settled lines);
  * adds what is left as its own run at level 0.
When a level has ``fanout`` runs they are compacted into one run of the next level, so that the runs a batch meets grow
with the logarithm of the number of batches.  A line is settled in exactly one row, so no total count is needed at the end.

Hot lines: lines of a batch are counted before they are dealt.  To find the lines of documents, lines that hold more
than one in ``HOT_SHARE`` of a batch's (document, line) rows are broadcast (at most ``HOT_SHARE`` a batch, by that
bound), all others are merge-joined, where none is hot.

Defined cases: a null text is one empty line.  Keys of fewer than ``min_chars`` code points never go.  Every row of the
table is a document, whatever its id, repeated rows included.  Lines are equal when two 64-bit hashes of their keys are.
Line ends other than \\n (\\r\\n too) are part of a line, and stripped from its key.  An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import delete_table, scratch_folder, written_table
from .common import map_batches, record

MIN_DOCS = 10
MIN_CHARS = 1
#: Batches that a whole table is added in.
BATCHES = 4
#: Runs of a level that make one run of the next.
FANOUT = 3
#: A line with more than one in so many rows of a batch is hot.
HOT_SHARE = 5_000

BLANK = " \t\n\x0b\x0c\r"
HASHES = ["line_hash", "line_hash2"]


def line_keys(text: Column) -> Column:
    """Array of the keys of the \\n-split lines: stripped, A-Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias(HASHES[0]), F.xxhash64(F.lit(1), key).alias(HASHES[1])]


@dataclass
class LineRuns:
    """Levelled sorted runs of line hashes, kept as bucketed tables in the shared scratch folder."""

    spark: SparkSession
    min_docs: int = MIN_DOCS
    fanout: int = FANOUT
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.paths, self.made = f"proofloom_lines_{uuid.uuid4().hex}", {}, 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def _files(self, runs: list[str]) -> DataFrame:
        """The rows of runs in one scan, in no order (a union of bucketed tables would pass for bucketed itself)."""
        return self.spark.read.schema("line_hash bigint, line_hash2 bigint, docs bigint, upto bigint").parquet(*[self.paths[run] for run in runs])

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *HASHES)

    def _write(self, rows: DataFrame) -> str:
        """A new run from rows that are dealt into the buckets."""
        self.made += 1
        run = f"{self.name}_{self.made}"
        self.paths[run] = scratch_folder(self.spark)
        rows.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", self.paths[run]).saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        delete_table(self.spark, self.paths.pop(run))

    def add(self, counts: DataFrame) -> None:
        """Add a batch: its line hashes, each once, with the number ``docs`` of its documents that hold the line."""
        rows, before = self._dealt(counts.select(*HASHES, "docs")), F.lit(0).cast("bigint")
        for i, run in enumerate(self.runs()):
            rows = rows.join(run.select(*HASHES, F.col("docs").alias(f"_docs{i}"), F.col("upto").alias(f"_upto{i}")), HASHES, "left")
            before = before + F.coalesce(F.col(f"_docs{i}"), F.lit(0))
        settled = [F.coalesce(F.col(f"_upto{i}") >= self.min_docs, F.lit(False)) for i in range(len(self.runs()))]
        new = rows.where(~F.greatest(*settled, F.lit(False), F.lit(False)))
        self._push(0, self._write(new.select(*HASHES, "docs", (before + F.col("docs")).alias("upto"))))

    def _push(self, level: int, run: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        rows = self._dealt(self._files(old))
        self._push(level + 1, self._write(rows.groupBy(*HASHES).agg(F.sum("docs").alias("docs"), F.max("upto").alias("upto"))))
        for run in old:
            self._drop(run)

    def settled(self) -> DataFrame:
        """Hashes of the lines that ``min_docs`` documents or more hold, each once."""
        return self._files([run for level in self.levels for run in level]).where(F.col("upto") >= self.min_docs).select(*HASHES)

    def close(self) -> None:
        """Delete the runs."""
        for run in [run for level in self.levels for run in level]:
            self._drop(run)
        self.levels = []


def batch_counts(docs: DataFrame, batch: Column, *, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """batch, line hashes, docs: how many documents of the batch hold the line."""
    keys = docs.select(batch.alias("batch"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key"))
    long = keys.where(F.length("key") >= min_chars)
    return long.select("batch", *_hashed(F.col("key"))).groupBy("batch", *HASHES).agg(F.count("*").alias("docs"))


def _kept(with_text: bool):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, dropped in zip(batch.column("_text").to_pylist(), batch.column("_dropped").to_pylist()):
            lines = (text or "").split("\n")
            gone = set(dropped or ())
            kept = "\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text or ""
            out.append((len(lines), len(gone), kept if with_text else hashlib.sha256(kept.encode()).hexdigest()))
        columns = {name: batch.column(name) for name in batch.schema.names if name not in ("_text", "_dropped")}
        lines, gone, kept = zip(*out) if out else ((), (), ())
        return record(**columns, n_lines=(lines, pa.int64()), n_dropped=(gone, pa.int64()), **{"kept_text" if with_text else "kept_sha256": (kept, pa.string())})

    return kernel


def drop_frequent_lines(
    docs: DataFrame, *, text: str = "text", keep: Iterable[str] = ("doc_id",), min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    batches: int = BATCHES, fanout: int = FANOUT, buckets: int = 0, with_text: bool = True,
) -> DataFrame:
    """The ``keep`` columns, n_lines, n_dropped and kept_text (or only kept_sha256) of every document.

    Documents are added to the runs in ``batches`` by a hash of the text; any other split gives the same result.
    """
    spark = docs.sparkSession
    counts, counts_path = written_table(batch_counts(docs, F.pmod(F.xxhash64(text), F.lit(batches)).cast("int"), text=text, min_chars=min_chars))
    totals = {r["batch"]: r["rows"] for r in counts.groupBy("batch").agg(F.sum("docs").alias("rows")).collect()}  # one row a batch
    runs = LineRuns(spark, min_docs, fanout, buckets)
    try:
        for batch in range(batches):
            runs.add(counts.where(F.col("batch") == batch))
        settled, settled_path = written_table(runs.settled())
    finally:
        runs.close()
    share = F.lit(None).cast("bigint")
    for batch, rows in totals.items():
        share = F.when(F.col("batch") == batch, F.lit(rows)).otherwise(share)
    often = counts.where(F.col("docs") * HOT_SHARE > share).select(*HASHES).distinct()  # fewer than HOT_SHARE a batch
    hot = settled.join(F.broadcast(often), HASHES, "left_semi").withColumn("_hot", F.lit(True))
    rest = settled.join(F.broadcast(often), HASHES, "left_anti")

    # What goes from a text depends on the text alone, so equal rows may share a key.
    kept = list(keep)
    identity = [F.xxhash64(*kept, text).alias("_row"), F.xxhash64(F.lit(1), *kept, text).alias("_row2")]
    lines = docs.select(*identity, F.posexplode(line_keys(F.col(text))).alias("_at", "_key")).where(F.length("_key") >= min_chars)
    placed = lines.select("_row", "_row2", "_at", *_hashed(F.col("_key"))).join(F.broadcast(hot), HASHES, "left")
    # Hot lines are known to go and meet no other row, so they may pass the merge join anywhere.
    spread = placed.withColumn("_spread", F.when(F.col("_hot"), 1 + F.pmod("_row", F.lit(HOT_SHARE))).otherwise(0))
    met = spread.join(rest.withColumns({"_spread": F.lit(0).cast("bigint"), "_met": F.lit(True)}), ["_spread", *HASHES], "left")
    gone = met.where(F.coalesce("_hot", "_met"))
    lists, lists_path = written_table(gone.groupBy("_row", "_row2").agg(F.collect_set("_at").alias("_dropped")))
    whole = docs.select(*identity, *kept, F.col(text).alias("_text")).join(lists, ["_row", "_row2"], "left").drop("_row", "_row2")
    for path in (counts_path, settled_path):
        delete_table(spark, path)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*[f"`{name}` {types[name]}" for name in kept], "n_lines bigint, n_dropped bigint", f"{'kept_text' if with_text else 'kept_sha256'} string"])
    return map_batches(whole, _kept(with_text), schema)
