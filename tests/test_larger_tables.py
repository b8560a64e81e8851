"""Steps that grew too fast with the tables: their plan, and their results on small cases."""

import itertools
import weakref

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from proofloom.llm import language, sentencepieces
from proofloom.operators import geometry, operations
from proofloom.plans import assignment
from proofloom.streaming import jobs


def test_many_short_parts_are_judged_without_a_frame_each(spark):
    limits = operations.Limits(60, 2, 100, 3)
    rows = spark.range(4_000).selectExpr(
        "id % 1000 as run", "id as request_id", "id div 1000 * 20 as epoch", "date'1970-01-01' as day", "40L as estimate",
        "if(id % 2 = 0, 10L, null) as settled", "if(id % 2 = 0, id div 1000 * 20 + 5, null) as settled_at").coalesce(1)
    found = operations.admit_requests(rows, "run", limits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    admitted = found.groupBy("run").agg({"request_id": "count"}).count(), {(r["request_id"] // 1000): r["admitted"] for r in found.where("run = 7").collect()}
    assert admitted == (1_000, {0: True, 1: True, 2: False, 3: True})


def test_stagnation_asks_its_state_once_per_bucket(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, "run bigint, snapshot_id bigint, done string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run bigint, snapshot_id bigint, done string").parquet(str(tmp_path / "in"))
        return {r["snapshot_id"]: r["stalled"] for r in jobs.drain(jobs.stagnation_stream(stream, "run", F.col("done")), str(tmp_path / "out")).collect()}

    first = [(run, run * 10 + i, f"{i % 3}") for run in range(5) for i in range(6)] + [(9, 900, None), (9, 901, None), (None, 950, "0")]
    found = arrive(first)
    assert {i for i, stalled in found.items() if not stalled} == {run * 10 + i for run in range(5) for i in range(3)} | {900, 950}
    found = arrive([(0, 100, "2"), (0, 101, "7"), (0, 102, "7"), (9, 103, None), (9, 104, "0")])  # a restart goes on from the state
    assert [found[i] for i in range(100, 105)] == [True, False, True, True, False] and len(found) == len(first) + 5


def test_stagnation_calls_its_state_for_no_single_signature():
    calls = []

    class State:
        def exists(self):
            return bool(calls)

        def get(self):
            calls.append("get")
            return iter(())

        def appendValue(self, value):
            calls.append(value)

    processor = jobs._Stagnation("run")
    processor.seen = State()
    rows = pd.DataFrame({"run": 1, "snapshot_id": range(50), "shown": [bytes([i % 20]) * 32 for i in range(50)]})
    out = pd.concat(processor.handleInputRows((0,), iter([rows.iloc[25:], rows.iloc[:25]]), None))
    assert len(calls) == 1 and len(calls[0][0]) == 20 * 32
    assert out.loc[~out["stalled"], "snapshot_id"].tolist() == list(range(20))


def test_draws_of_small_pages_meet_in_one_row(spark):
    rng = np.random.default_rng(5)
    rows = []
    for page in range(60):
        for z in range(int(rng.integers(1, 14))):
            a, d, e, f = (float(v) for v in (rng.integers(-4, 15), rng.integers(1, 13), rng.integers(-3, 12), rng.integers(-3, 9)))
            rows.append((page if page else None, z // 2 if page % 7 == 3 else z, a, [0.0, 0.0, 0.0, 0.2, None][int(rng.integers(0, 5))] if page % 5 == 0 else 0.0, 0.0, d, e, f, f"{page}/{z}"))
    draws = spark.createDataFrame(rows, "page_id bigint, z int, a double, b double, c double, d double, e double, f double, name string")
    pages = spark.range(60).selectExpr("id as page_id", "0D as left", "0D as bottom", "16D as right", "12D as top")
    in_rows, in_cells, mixed = (geometry.drop_occluded(draws, pages, cell=4.0, row_draws=limit) for limit in (64, 0, 6))
    assert in_rows._jdf.queryExecution().executedPlan().toString().count("Exchange hash") < 4
    names = sorted(r["name"] for r in in_rows.collect())
    unlike = draws.where("page_id % 7 <> 3")  # cells add up what draws of one z hide together
    apart = lambda df: sorted(r["name"] for r in df.join(unlike.select("name"), "name").collect())
    assert apart(in_rows) == apart(in_cells) == apart(mixed) and 0 < len(names) < len([r for r in rows if r[0]])


def test_small_pieces_are_solved_many_to_a_task(spark):
    rng = np.random.default_rng(8)
    costs = rng.integers(0, 50, (400, 3, 4)) / 8.0
    offers = [(f"p{p}", p % 5, p * 10 + t, p * 10 + c, float(costs[p, t, c])) for p in range(400) for t in range(3) for c in range(4)]
    offers += [("lone", 7, 9_000 + t, 9_000, float(t)) for t in range(4)]  # four targets, one candidate
    found = assignment._solve_pieces(spark.createDataFrame(offers, "piece string, block bigint, target bigint, candidate bigint, cost double").repartition(3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan and found.rdd.getNumPartitions() > 1
    rows = found.collect()
    least = sum(min(sum(costs[p, t, c] for t, c in enumerate(taken)) for taken in itertools.permutations(range(4), 3)) for p in range(400))
    assert sum(r["cost"] for r in rows if r["block"] < 7) == least and not any(r["short"] for r in rows if r["block"] < 7)
    assert {r["target"]: (r["candidate"], r["cost"], r["short"]) for r in rows if r["block"] == 7} == {9_000: (9_000, 0.0, True), **{9_000 + t: (None, None, True) for t in (1, 2, 3)}}


def test_a_worker_keeps_the_memo_of_one_stage_only():
    path = sentencepieces.default_model()
    held = sentencepieces.encoder(path)
    assert sentencepieces.encoder(path) is held
    gone = weakref.ref(held)
    del held
    model = language.LanguageModel(["a", "b"], [{"word": 0}], [np.zeros((1, 2))])
    rows = weakref.ref(language.word_rows(model).matrix)
    assert gone() is None and rows() is language.word_rows(model).matrix
    sentencepieces.encoder(path, text=False)
    assert rows() is None
