"""Operational analytics: request quotas, step durations, repeated progress."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chunks import following, running_sum, trailing_sums
from ..plans.lineage import delete_table, written_table

QUOTA_ZONE = "America/Los_Angeles"  # fixed value: the zone whose midnight resets the daily quota


#: Requests of a key that run in one go.
CHUNK_REQUESTS = 50_000


@dataclass(frozen=True)
class Limits:
    """Fixed values by default: requests and tokens per minute, requests per day."""

    window: int = 60
    requests: int = 15
    tokens: int = 250_000
    daily: int = 500


def quota_day(at: Column) -> Column:
    """Calendar day of a UTC instant in the quota's zone."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), QUOTA_ZONE))


def rolling_usage(requests: DataFrame, keys: list[str], epoch: str, day: str, tokens: Column, order: str, window: int = 60) -> DataFrame:
    """Usage as each request sees it: requests and tokens in the window, requests of the day so far."""
    hour = F.floor(F.col(epoch) / 3600)
    counted = running_sum(requests, [*keys, day], hour, [F.col(epoch), F.col(order)], F.lit(1).cast("bigint"), "day_requests")
    return trailing_sums(requests, keys, epoch, window, 3600, {"window_requests": F.lit(1), "window_tokens": tokens}, onto=counted)


def step_durations(log: DataFrame, run: list[str], at: str, order: str) -> DataFrame:
    """Microseconds from each step to the run's next one; null for its last."""
    marked = log.withColumn("_micros", F.unix_micros(F.col(at).cast("timestamp")))
    timed = following(marked, run, F.floor(F.col("_micros") / 86_400_000_000), [F.col("_micros"), F.col(order)], "_micros", "_next")
    return timed.withColumn("micros", F.col("_next") - F.col("_micros")).drop("_micros", "_next")


def step_totals(durations: DataFrame, step: list[str]) -> DataFrame:
    return durations.groupBy(*step).agg(F.count("micros").alias("steps"), F.sum("micros").alias("total_micros"), F.max("micros").alias("longest_micros"))


def stagnation(snapshots: DataFrame, run: list[str], progress: list[str], at: str, order: str) -> DataFrame:
    """Marks snapshots whose progress equals an earlier one of the run; times never count as progress."""
    signed = snapshots.withColumn("signature", F.sha2(F.to_json(F.struct(*sorted(progress)), {"ignoreNullFields": "false"}), 256))
    place = F.struct(F.col(at), F.col(order))
    keys = [*run, "signature"]
    first = signed.groupBy(*[F.col(name).alias(f"_own_{name}") for name in keys]).agg(F.min(place).alias("_first"))
    same = F.lit(True)
    for name in keys:
        same = same & F.col(name).eqNullSafe(F.col(f"_own_{name}"))
    return signed.join(first, same).withColumn("stalled", place > F.col("_first")).drop("_first", *[f"_own_{name}" for name in keys])


class Ledger:
    """Admitted requests of one key: those inside the window, and the count of the current day."""

    def __init__(self, limits: Limits, recent: list[tuple] | None = None, day: str | None = None, today: int = 0):
        self.limits, self.recent, self.day, self.today = limits, list(recent or []), day, today

    def admit(self, epoch: int, day: str, estimate: int, settled: int | None, settled_at: int | None) -> bool:
        """Reserve a request if every limit allows it; a settled one counts what it really used."""
        if day != self.day:
            self.day, self.today = day, 0
        self.recent = [entry for entry in self.recent if entry[0] > epoch - self.limits.window]
        used = sum(real if real is not None and known is not None and known <= epoch else guess for _, guess, real, known in self.recent)
        estimate = max(1, estimate)
        allowed = (
            len(self.recent) < self.limits.requests and used + estimate <= self.limits.tokens and self.today < self.limits.daily
        )
        if allowed:
            self.recent.append((epoch, estimate, settled, settled_at))
            self.today += 1
        return allowed


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def admit_rows(ledger: Ledger, rows: pd.DataFrame) -> list[bool]:
    columns = zip(rows["epoch"], rows["day"], rows["estimate"], rows["settled"], rows["settled_at"])
    return [ledger.admit(int(e), str(d), int(t), _whole(s), _whole(k)) for e, d, t, s, k in columns]


_CHUNK = "_place string, _key {key}, request_id {id}, admitted boolean, head_day string, head bigint, tail_day string, tail bigint, recent string"


def _run_chunks(rows: DataFrame, limits: Limits) -> DataFrame:
    """Verdicts of chunks (``_place``) from their start states, and a last row (admitted null) of each with what it leaves:
    first and last day, requests admitted in each of them here, and the admitted requests still inside the window."""
    schema = _CHUNK.format(key=dict(rows.dtypes)["_key"], id=dict(rows.dtypes)["request_id"])
    read = ["_place", "_key", "request_id", "epoch", "day", "estimate", "settled", "settled_at", "_today", "_recent"]
    names, text, whole = [column.split()[0] for column in schema.split(", ")], pa.string(), pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most keys are cut into many short parts: rows are walked as plain values, without a frame for each part.
        place, ledger, day, started, head = None, None, None, 0, 0

        def left() -> tuple:
            tail = ledger.today - (started if ledger.day == day else 0)
            return place, None, None, None, day, head, ledger.day, tail, json.dumps(ledger.recent)

        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held, kind) for held, kind in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            out = []
            kinds = [text, *(batch.column(column).type for column in ("_key", "request_id")), pa.bool_(), text, whole, text, whole, text]
            for name, owner, request, epoch, date, estimate, settled, settled_at, today, recent in zip(*(batch.column(column).to_pylist() for column in read)):
                date = str(date)
                if name != place:
                    if place is not None:
                        out.append(left())
                    place, head, day, started = name, 0, date, today
                    ledger = Ledger(limits, [tuple(entry) for entry in json.loads(recent)], day, started)
                allowed = ledger.admit(epoch, date, estimate, settled, settled_at)
                head += allowed and date == day
                out.append((name, owner, request, allowed, None, None, None, None, None))
            if out:
                yield table(out)
        if place is not None:
            yield table([left()])

    return rows.select(*read).repartition("_place").sortWithinPartitions("_place", "epoch", "request_id").mapInArrow(run, schema)


def _due(ends: DataFrame, limits: Limits) -> DataFrame:
    """Chunks that must run again: what the chunks before them leave is not what they started from, and may matter."""
    chain = Window.partitionBy("_key", "_part").orderBy("_chunk")
    carries = F.coalesce(F.col("head_day") == F.lag("tail_day").over(chain), F.lit(False))
    breaks = (~F.col("_carries") | (F.col("head_day") != F.col("tail_day"))).cast("int")
    grouped = ends.withColumn("_carries", carries).withColumn("_days", F.sum(breaks).over(chain))
    summed = grouped.withColumn("_sum", F.sum("tail").over(Window.partitionBy("_key", "_part", "_days").orderBy("_chunk")))
    due = summed.withColumns({
        "_new_today": F.when(F.col("_carries"), F.lag("_sum").over(chain)).otherwise(0).cast("bigint"), "_new_recent": F.coalesce(F.lag("recent").over(chain), F.lit("[]")),
    })
    # As long as the day's count stays below its limit with either start, it denies nothing.
    counts = (F.col("_new_today") != F.col("_today")) & (F.greatest("_new_today", "_today") + F.col("head") >= limits.daily)
    return due.where((F.col("_new_recent") != F.col("_recent")) | counts).select("_place", F.col("_new_today").alias("_today"), F.col("_new_recent").alias("_recent"))


def admit_requests(requests: DataFrame, key: str, limits: Limits, chunk: int = CHUNK_REQUESTS) -> DataFrame:
    """Whether each request is admitted, given that denied ones use nothing.

    ``requests``: key, request_id, epoch, day, estimate, settled, settled_at.  Admission depends on
    what was admitted before.  A key is cut wherever a new day starts after a full quiet window, since
    nothing is carried over there, and besides into chunks of ``chunk`` requests.  All chunks run at
    once, from the guess that the chunk before leaves nothing; those that turn out to have started
    from something else run again, until none is left.  So a busy key keeps many tasks at work.
    """
    order = [F.col("epoch"), F.col("request_id")]
    days = F.datediff(F.col("day"), F.lit("1970-01-01"))
    here = requests.withColumn("_here", F.struct("epoch", "day"))
    chained = following(here, [key], days, order, "_here", "_next")
    cut = F.when((F.col("_next.epoch") - F.col("epoch") >= limits.window) & (F.col("_next.day") != F.col("day")), 1).otherwise(0)
    both = F.lit(1 << 32)  # one running sum holds the row number above and the cuts below
    counted = running_sum(chained.withColumn("_cut", cut.cast("bigint")), [key], days, order, both + F.col("_cut"), "_sums")
    placed = counted.withColumns({"_part": F.pmod("_sums", both) - F.col("_cut"), "_chunk": F.floor((F.shiftright("_sums", 32) - 1) / chunk)})
    parts = placed.select(
        F.col(key).alias("_key"), "_part", "_chunk", F.to_json(F.struct(key, "_part", "_chunk")).alias("_place"), "request_id", "epoch",
        F.col("day").cast("string").alias("day"), "estimate", "settled", "settled_at",
    )
    rows, _ = written_table(parts)
    nothing = {"_today": F.lit(0).cast("bigint"), "_recent": F.lit("[]")}
    first = _run_chunks(rows.withColumns(nothing), limits)
    verdict = ["_key", "request_id", "admitted"]
    if not rows.agg(F.max("_chunk").alias("most")).first()["most"]:  # no key has more than a chunk: nothing comes before
        return first.where(F.col("admitted").isNotNull()).select(F.col("_key").alias(key), *verdict[1:])
    rounds = [written_table(first)[0]]
    left = ["_place", "head_day", "head", "tail_day", "tail", "recent"]
    chunks = rows.select("_key", "_part", "_chunk", "_place").distinct()
    several = chunks.withColumn("_several", F.count("*").over(Window.partitionBy("_key", "_part"))).where(F.col("_several") > 1).drop("_several")
    ends = several.join(rounds[0].where(F.col("admitted").isNull()).select(*left), "_place").withColumns(nothing | {"_round": F.lit(0)})
    ends, path = written_table(ends)
    while True:
        due, due_path = written_table(_due(ends, limits))
        if due.isEmpty():
            break
        rounds.append(written_table(_run_chunks(rows.join(due, "_place"), limits))[0])
        again = rounds[-1].where(F.col("admitted").isNull()).select(*left).join(due, "_place").withColumn("_round", F.lit(len(rounds) - 1))
        stay = ends.join(due, "_place", "left_anti")
        moved = several.join(again, "_place").select(*stay.columns)
        ends, new = written_table(stay.unionByName(moved))
        for old in (path, due_path):
            delete_table(requests.sparkSession, old)
        path = new
    judged = [found.where(F.col("admitted").isNotNull()).select("_place", *verdict) for found in rounds]
    verdicts = judged[0]
    if len(rounds) > 1:
        final = ends.where(F.col("_round") > 0).select("_place", "_round")
        verdicts = verdicts.join(final, "_place", "left_anti")
        for number, found in enumerate(judged[1:], 1):
            verdicts = verdicts.unionByName(found.join(final.where(F.col("_round") == number), "_place", "left_semi"))
    return verdicts.select(F.col("_key").alias(key), *verdict[1:])
