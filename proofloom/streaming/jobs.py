"""Streaming forms of the activity log, the request ledger and the credit map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.joins import merge_with_override
from ..operators.operations import Ledger, Limits, admit_rows
from ..plans.lineage import scratch_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of the progress that runs have shown, by its hash; a hash is 32 bytes.
SHOWN_BUCKETS, SHOWN = 1_024, "S32"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step_counts(log: DataFrame, at: str, step: list[str], width: str, delay: str) -> DataFrame:
    """Steps per window of the activity log; a window comes out once it can no longer change."""
    return log.withWatermark(at, delay).groupBy(F.window(at, width), *step).agg(F.count("*").alias("steps"))


def usage_windows(requests: DataFrame, at: str, keys: list[str], tokens: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Requests and tokens per tumbling or sliding window; later rows than the delay are dropped."""
    return requests.withWatermark(at, delay).groupBy(F.window(at, width, slide), *keys).agg(
        F.count("*").alias("requests"), F.sum(tokens).alias("tokens")
    )


def first_arrivals(assets: DataFrame, at: str, delay: str) -> DataFrame:
    """Assets whose content was not seen within the delay; the first arrival is kept."""
    return assets.withWatermark(at, delay).dropDuplicatesWithinWatermark(["length", "sha256"])


def run_sessions(log: DataFrame, at: str, run: list[str], gap: str, delay: str) -> DataFrame:
    """Runs as sessions: start, end and steps, closed by a gap without activity."""
    return log.withWatermark(at, delay).groupBy(F.session_window(at, gap), *run).agg(F.count("*").alias("steps"))


class _Admission(StatefulProcessor):
    """Keeps the admitted requests of the window and the day's count for one key."""

    def __init__(self, key: str, limits: Limits):
        self.key, self.limits = key, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "epoch BIGINT, estimate BIGINT, settled BIGINT, settled_at BIGINT")
        self.today = handle.getValueState("today", "day STRING, admitted BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        day, admitted = self.today.get() if self.today.exists() else (None, 0)
        ledger = Ledger(self.limits, [tuple(entry) for entry in self.recent.get()], day, admitted)
        batch = pd.concat(list(rows)).sort_values(["epoch", "request_id"])
        verdicts = admit_rows(ledger, batch)
        self.recent.put([tuple(entry) for entry in ledger.recent])
        self.today.update((ledger.day, ledger.today))
        yield pd.DataFrame({self.key: key[0], "request_id": batch["request_id"], "admitted": verdicts})

    def close(self) -> None:
        pass


class _Stagnation(StatefulProcessor):
    """Remembers what the runs of a bucket have shown, for ``keep_ms`` after it was first seen (None: for good).

    A bucket's state is a list of blocks, one of sorted hashes per micro-batch: it is asked once per bucket, not once per signature.
    """

    def __init__(self, run: str, keep_ms: int | None = None):
        self.run, self.keep_ms = run, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "shown BINARY", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # A bucket's rows come in Arrow batches of any order; the first snapshot of a signature is the least of all.
        batch = pd.concat(list(rows)).sort_values("snapshot_id")
        shown, first = np.unique(np.array(batch["shown"].tolist(), dtype=SHOWN), return_index=True)
        unseen = np.ones(len(shown), dtype=bool)
        for (block,) in list(self.seen.get()) if self.seen.exists() else []:
            held = np.frombuffer(block, dtype=SHOWN)
            unseen &= held[np.minimum(np.searchsorted(held, shown), len(held) - 1)] != shown
        if unseen.any():
            self.seen.appendValue((shown[unseen].tobytes(),))
        stalled = np.ones(len(batch), dtype=bool)
        stalled[first[unseen]] = False
        yield pd.DataFrame({self.run: batch[self.run], "snapshot_id": batch["snapshot_id"], "stalled": stalled})

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, key: str, limits: Limits) -> DataFrame:
    """Streaming form of ``admit_requests``; requests of a key must arrive in order between batches."""
    types = dict(requests.dtypes)
    return requests.groupBy(key).transformWithStateInPandas(
        _Admission(key, limits), f"{key} {types[key]}, request_id {types['request_id']}, admitted boolean", "append", "None"
    )


def stagnation_stream(snapshots: DataFrame, run: str, signature: Column, keep_ms: int | None = None) -> DataFrame:
    """Snapshots (run, snapshot_id, ...) that repeat progress the run has shown before.

    With ``keep_ms`` progress is forgotten after that time, which bounds the state of endless streams.
    """
    shown = F.unhex(F.sha2(F.to_json(F.struct(F.col(run), signature.alias("signature")), {"ignoreNullFields": "false"}), 256))
    signed = snapshots.select(run, "snapshot_id", shown.alias("shown")).withColumn("_bucket", F.pmod(F.xxhash64("shown"), F.lit(SHOWN_BUCKETS)))
    return signed.groupBy("_bucket").transformWithStateInPandas(
        _Stagnation(run, keep_ms), f"{run} {dict(snapshots.dtypes)[run]}, snapshot_id {dict(snapshots.dtypes)['snapshot_id']}, stalled boolean",
        "append", "None" if keep_ms is None else "ProcessingTime",
    )


def _available_now(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything available and read the result back as a table."""
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        _available_now(stream.writeStream.format("parquet").option("path", f"{folder}/table").outputMode("append"), f"{folder}/progress")
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def _versions(spark, folder: str) -> list[int]:
    """Numbers of the completely written versions of the map."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/before=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [int(status.getPath().getParent().getName().split("=")[1]) for status in found]


def upsert_credits(refreshes: DataFrame, existing: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Apply each micro-batch of refreshed credits to the stored map; one version of it per batch.

    Each micro-batch is one whole refresh.  It reads the version before its own id and writes its
    own, so a batch that is run again after a failure gives the same result.  ``existing`` is stored
    on the first start only; a restart goes on from the latest version in the folder.
    """
    spark = existing.sparkSession
    if not _versions(spark, folder):
        existing.write.parquet(f"{folder}/before=0")

    def apply(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.parquet(f"{folder}/before={batch_id}")
        merge_with_override(stored, batch, keys).write.mode("overwrite").parquet(f"{folder}/before={batch_id + 1}")

    _available_now(refreshes.writeStream.foreachBatch(apply), f"{folder}/progress")
    return spark.read.parquet(f"{folder}/before={max(_versions(spark, folder))}")
