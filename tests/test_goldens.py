"""Small cases with known answers, one per rule."""

import datetime
import hashlib
import io
import random
import re
import zipfile
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofloom.catalog import operations as operations_catalog
from proofloom.functions import clearance, codes, notes, prices, text
from proofloom.operators import cleaning, evidence, geometry, joins, operations, review, rollups
from proofloom.plans import chunks
from proofloom.sources import assets, files, workbook
from proofloom.streaming import jobs

PRICES = [
    ("47 310,00", "47310.00"), ("8 205 ₽", "8205.00"), ("8 205,75 руб.", "8205.75"), ("3 004 500,00", "3004500.00"),
    ("12.640,00", "12640.00"), ("12,640.00", "12640.00"), ("7312.0", "7312.00"), ("9,480", "9480.00"), ("9.480", "9480.00"),
    ("0", "0.00"), ("0,725", "725.00"), ("2,345,678.5", "2345678.50"), ("", None), ("по запросу", None), ("40 / 80", None),
    ("inf", None), ("-55", None), ("70 EUR", None), ("31,42,0", None), ("7.1234", None), ("7.1200", None), ("4.500,000,25", None),
]


def test_prices(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(PRICES)], "i int, raw string")
    got = rows.select("i", prices.parse_price(F.col("raw")).alias("p"), prices.price_error(F.col("raw")).alias("e")).orderBy("i").collect()
    assert [r["p"] for r in got] == [None if expected is None else Decimal(expected) for _, expected in PRICES]
    assert all((r["p"] is None) == (r["e"] is not None) for r in got)
    assert got[18]["e"] == "ambiguous" and got[13]["e"] == "unrecognised"


def sheet(left_price="Цена", right_price="Корректная цена", second_name="Перчатки", second_price="7450"):
    """Two sheets of two products with a price column before and one after an unheaded description."""
    rows = [
        ["", "№", "Наименование", "Бренд", "Артикул", "Оттенок", left_price, "", right_price],
        ["", "7", "Куртка", "NORD", "00412077", "NAVY", "31 200,00", "Стёганая куртка", "28900"],
        ["", "", second_name, "NORD", "5530918", "RUST", "9 100,00", "Кожаные перчатки", second_price],
    ]
    return [(name, row, col, "s", value) for name in "WM" for row, values in enumerate(rows, 1) for col, value in enumerate(values, 1) if value]


def products_of(spark, cells):
    rows = cleaning.sheet_rows(spark.createDataFrame(cells, "sheet string, row bigint, col int, ctype string, value string"), ["sheet"])
    sheets = cleaning.infer_price_column(rows, ["sheet"], cleaning.find_headers(rows, ["sheet"]))
    return sheets, cleaning.product_rows(rows, ["sheet"], sheets)


@pytest.mark.parametrize("header", ["Корректная цена", "Цена", ""])
def test_price_column_is_found_marked_labelled_or_blank(spark, header):
    sheets, products = products_of(spark, sheet(right_price=header))
    assert {r["price_col"] for r in sheets.collect()} == {9}
    found = products.where("is_product").collect()
    assert len(found) == 4 and {r["article"] for r in found} == {"00412077", "5530918"} and {r["price"] for r in found} == {"28900", "7450"}


def test_marked_price_beats_a_later_one_and_must_be_single(spark):
    sheets, _ = products_of(spark, sheet(left_price="Корректная цена", right_price="Цена"))
    assert {r["price_col"] for r in sheets.collect()} == {7}
    sheets, _ = products_of(spark, sheet(left_price="Корректная цена"))
    assert {r["error"] for r in sheets.collect()} == {"several correct-price columns"}


def test_bad_price_and_missing_name_are_violations(spark):
    _, products = products_of(spark, sheet(right_price="", second_price="по запросу"))
    assert {(r["row"], r["rule"]) for r in cleaning.check_products(products, ["sheet"]).collect()} == {(3, "price not an amount")}
    _, products = products_of(spark, sheet(second_name=""))
    assert {(r["row"], r["rule"]) for r in cleaning.check_products(products, ["sheet"]).collect()} == {(3, "field name")}


def test_exact_copies(spark):
    rows = [("A copy.jpg", "abcd"), ("A.jpg", "abcd"), ("unrelated-name.jpeg", "abcd"), ("retouch copy.jpg", "abce")]
    for order in (rows, rows[::-1]):
        files_ = assets.content_identity(spark.createDataFrame(order, "n string, c string"), F.col("n"), F.col("c"))
        unique = assets.dedupe_exact(files_)
        assert {r["selected"] for r in unique.collect()} == {"A.jpg", "retouch copy.jpg"}
        copies = assets.exact_copies(files_, unique).collect()
        assert {r["name"] for r in copies} == {"A copy.jpg", "unrelated-name.jpeg"} and {r["length"] for r in copies} == {4}
        kept = assets.dedupe_exact(files_, F.lower("name") == "a copy.jpg")
        assert {r["selected"] for r in kept.collect()} == {"A copy.jpg", "retouch copy.jpg"}


def test_scan_hashes_only_shared_lengths(spark, tmp_path):
    for name, content in (("a.jpg", b"1234"), ("b.jpg", b"1234"), ("c.jpg", b"12345")):
        (tmp_path / name).write_bytes(content)
    found = {r["name"]: r["sha256"] for r in assets.scan_collisions(spark, str(tmp_path), "*.jpg").collect()}
    assert found["a.jpg"] == found["b.jpg"] is not None and found["c.jpg"] is None
    assert len(assets.dedupe_exact(assets.scan_collisions(spark, str(tmp_path))).collect()) == 2
    assert all(r["sha256"] for r in assets.scan_assets(spark, str(tmp_path)).collect())


NOTES = [
    ("garment=red coat; bag=brown leather pouch with a chain", {"garment", "bag", "colour"}),
    ("Синий пиджак и чёрная сумка в руке", {"garment", "bag", "colour"}),
    ("seems to be the same outfit as before", set()),
    ("accessories: кольцо; clothing: платье", {"accessory", "garment"}), ("поза: в\u00a0полный\u00a0рост", {"pose"}),
]


def test_cues(spark):
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NOTES)], "i int, n string")
    got = rows.select("i", notes.cue_categories(F.col("n")).alias("c")).orderBy("i").collect()
    assert [set(r["c"]) for r in got] == [expected for _, expected in NOTES]


def test_sanitized_note(spark):
    row = spark.range(1).select(text.sanitize_note(F.lit("  Платье||сумка\nи обувь   ")).alias("n")).first()
    assert row["n"] == "Платье;сумка и обувь"


def test_decisions(spark):
    good = '{"look_id": "LOOK_001", "accepted": true, "note": "garment=white blazer; bag=black tote"}'
    bad = '{"look_id": "LOOK_002", "accepted": true, "note": "x", "contradictions": ["other shoes"]}'
    responses = spark.createDataFrame([(1, 'Sure: {"decisions": [%s, %s]} done' % (good, bad)), (2, '{"decisions": [%s, %s]}' % (good, good))], "b int, raw string")
    asked = spark.createDataFrame([(1, "LOOK_001"), (1, "LOOK_002"), (2, "LOOK_001"), (2, "LOOK_003")], "b int, look string")
    got = {(r["b"], r["look"]): (r["accepted"], r["error"], r["batch_ok"]) for r in notes.parse_decisions(responses, asked, "b", "look", "raw").collect()}
    assert got[(1, "LOOK_001")] == (True, None, True) and got[(1, "LOOK_002")] == (False, None, True)
    assert got[(2, "LOOK_001")][1] == "repeated" and got[(2, "LOOK_003")] == (False, "no decision", False)


MAP4 = [(f"LOOK_{i:03}", "W", str(i), "PENDING") for i in range(1, 5)]


@pytest.mark.parametrize("wanted, kept", [
    ({4: "W:3"}, set()), ({3: "W:4", 4: "W:3", 1: "W:2"}, {3, 4}), ({1: "K:1", 2: "W:1", 3: "W:4"}, {1, 2}), ({2: "K:5", 3: "K:5", 4: "K:6"}, {4}),
    ({1: "K:2", 2: "W:1", 3: "W:2", 4: "W:3"}, {1, 2, 3, 4}), ({1: "W:3", 3: "W:4", 4: "W:1", 2: "K:1"}, {1, 2, 3, 4}), ({}, set()),
])
def test_closed_swaps(spark, wanted, kept):
    rows = [(1, f"LOOK_{k:03}", *card.split(":")) for k, card in wanted.items()]
    current = spark.createDataFrame([(1, *row) for row in MAP4], "project int, look_id string, excel_sheet string, excel_look_number string, visual_status string")
    asked = spark.createDataFrame(rows, "project int, look_id string, excel_sheet string, excel_look_number string")
    assert {int(r["look_id"][5:]) for r in review.closed_swaps(asked, current).collect()} == kept


def test_swap_components(spark):
    schema = "project int, look_id string, excel_sheet string, excel_look_number string"
    current = spark.createDataFrame([(1, f"LOOK_{i:03}", "W", str(i)) for i in range(1, 10)], schema)
    pairs = spark.createDataFrame([(1, "LOOK_001", "w", "2"), (1, "LOOK_002", "W", "1"), (1, "LOOK_003", "M", "1"), (1, "LOOK_008", "W", "9")], schema)
    got = {r["look_id"]: (r["first_look"], r["size"], r["error"]) for r in review.swap_components(pairs, current).collect()}
    assert got["LOOK_001"] == got["LOOK_002"] == ("LOOK_001", 2, None) and got["LOOK_003"] == ("LOOK_003", 1, None)
    assert got["LOOK_008"][2] == "owner outside the request"
    ring = spark.createDataFrame([(1, f"LOOK_{i:03}", "W", str(i % 6 + 1)) for i in range(1, 7)], schema)
    assert {r["error"] for r in review.swap_components(ring, current).collect()} == {"too many linked looks"}


def test_manual_choice_survives_a_refresh(spark):
    columns = "project int, look_id string, excel_sheet string, excel_look_number string, excel_image string, evidence_file string, visual_status string, note string"
    existing = spark.createDataFrame([(1, "LOOK_001", "M", "9", "", "", "CONFIRMED", "mine", 1), (1, "LOOK_002", "W", "2", "", "", "PENDING", "", 0)], columns + ", manual_override int")
    def refresh(number):
        incoming = spark.createDataFrame([(1, "LOOK_001", "m", number, "", "", "PENDING", "new")], columns)
        return {r["look_id"]: (r["excel_look_number"], r["manual_override"], r["note"]) for r in joins.merge_with_override(existing, incoming, ["project", "look_id"]).collect()}
    assert refresh("1") == {"LOOK_001": ("9", 1, "mine")} and refresh("9") == {"LOOK_001": ("9", 0, "mine")}


def test_revision_history(spark):
    rows = spark.createDataFrame([(1, "A", "a0", "a1"), (2, "B", "b0", "b1"), (3, "A", "a1", "a2"), (4, "B", "bX", "b2")], "revision bigint, look string, before string, after string")
    merged = {r["look"]: (r["before"], r["after"]) for r in evidence.compose_history(rows, ["look"], "revision", "before", "after").collect()}
    assert merged == {"A": ("a0", "a2"), "B": ("b0", "b2")}
    assert [(r["look"], r["revision"]) for r in evidence.history_breaks(rows, ["look"], "revision", "before", "after", 2).collect()] == [("B", 4)]


#: Width, height, left and bottom of a draw on a page of 600 by 400, then of one drawn later, and whether the first shows.
DRAWS = [
    ((650, 500, -20, -40), None, True), ((80, 60, 610, 10), None, False), ((80, 60, 600, 10), None, False), ((80, 60, 30, 400), None, False),
    ((70, 50, 200, 120), (90, 90, 190, 100), False), ((70, 50, 200, 120), (35, 50, 200, 120), True),
    ((70, 50, 200, 120), (68.5, 48.5, 200.75, 120.75), False), ((70, 50, 200, 120), (50, 50, 200, 120), True),
    ((900, 700, -100, -100), (600, 400, 0, 0), False), ((900, 700, -100, -100), (540, 400, 0, 0), True),
]


def test_visible_draws(spark):
    rows = []
    for page, (draw, later, _) in enumerate(DRAWS):
        for z, box in enumerate(box for box in (draw, later) if box):
            a, d, e, f = map(float, box)
            rows.append((page, z, a, 0.0, 0.0, d, e, f))
    rows += [(99, 0, 50.0, 0.0, 0.0, 50.0, 0.0, 0.0), (99, 1, 60.0, 0.1, 0.0, 60.0, 0.0, 0.0)]
    draws = spark.createDataFrame(rows, "page_id int, z int, a double, b double, c double, d double, e double, f double")
    pages = draws.select("page_id").distinct().selectExpr("page_id", "0D as left", "0D as bottom", "600D as right", "400D as top")
    shown = {(r["page_id"], r["z"]) for r in geometry.drop_occluded(draws, pages).collect()}
    assert [(page, 0) in shown for page in range(len(DRAWS))] == [expected for _, _, expected in DRAWS]
    assert (99, 0) in shown


def test_covered_area_equals_counted_cells(spark):
    rng = np.random.default_rng(2)
    boxes = [(key, *sorted(rng.choice(12, 2, replace=False).tolist()), *sorted(rng.choice(12, 2, replace=False).tolist())) for key in range(12) for _ in range(key + 1)]
    frame = spark.createDataFrame([(k, float(x0), float(y0), float(x1), float(y1)) for k, x0, x1, y0, y1 in boxes], "k int, left double, bottom double, right double, top double")
    cells = {key: {(x, y) for k, x0, x1, y0, y1 in boxes if k == key for x in range(x0, x1) for y in range(y0, y1)} for key in range(12)}
    assert {r["k"]: r["covered"] for r in geometry.covered_area(frame, ["k"]).collect()} == {key: float(len(held)) for key, held in cells.items()}


def test_image_owner(spark):
    areas = spark.createDataFrame([("W", 2, 9, 1), ("W", 10, 17, 2)], "sheet string, first bigint, last bigint, number int")
    numbers = spark.createDataFrame([("W", 2, 1), ("W", 10, 2), ("W", 40, 3)], "sheet string, row bigint, number int")
    images = spark.createDataFrame([("W", 1, 6, 6), ("W", 2, 15, 15), ("W", 3, 6, 13), ("W", 4, 41, 42), ("W", 5, 60, 60)], "sheet string, image int, start bigint, end bigint")
    got = {r["image"]: r["owner"] for r in geometry.image_owner(images, areas, numbers, ["sheet"], bucket=8).collect()}
    assert got == {1: 1, 2: 2, 3: None, 4: 3, 5: None}


def test_clearance(spark):
    row = spark.range(1).select(
        clearance.clearance_status(F.lit(0.009323), F.lit(0.000065)).alias("a"), clearance.clearance_status(F.lit(0.009323)).alias("b"),
        codes.page_in_range(F.lit("1-3, 7"), F.lit(7)).alias("c"), codes.page_in_range(F.lit("1-3,x"), F.lit(4)).alias("d"),
        text.next_revision(F.lit("A_LB_WA_09")).alias("e"), text.next_revision(F.lit("A_LB_99")).alias("f"), text.next_revision(F.lit("A_1")).alias("g"),
        text.col_index(F.lit("XFD")).alias("h"), text.col_letter(F.lit(16384)).alias("i"),
    ).first()
    assert tuple(row) == ("CLEAR", "COLLISION", True, False, "A_LB_WA_10", "A_LB_100", None, 16384, "XFD")


def ledger_by_hand(rows, limits):
    admitted, verdicts = [], {}
    for r in rows.sort_values(["run", "epoch", "request_id"]).itertuples():
        mine = [x for x in admitted if x.run == r.run]
        recent = [x for x in mine if x.epoch > r.epoch - limits.window]
        used = sum(x.settled if not pd.isna(x.settled) and x.settled_at <= r.epoch else max(1, x.estimate) for x in recent)
        ok = len(recent) < limits.requests and used + max(1, r.estimate) <= limits.tokens and sum(x.day == r.day for x in mine) < limits.daily
        verdicts[r.request_id] = ok
        if ok:
            admitted.append(r)
    return verdicts


def test_admission_against_brute_force(spark):
    rng = np.random.default_rng(3)
    size, limits = 600, operations.Limits(60, 4, 300, 40)
    epoch = np.sort(rng.integers(0, 4 * 86400, 40))[rng.integers(0, 40, size)] + rng.integers(0, 300, size)
    rows = pd.DataFrame({"run": rng.integers(0, 3, size) // 2, "request_id": np.arange(size), "epoch": epoch, "estimate": rng.integers(0, 120, size)})
    rows["day"] = [datetime.date(1970, 1, 1) + datetime.timedelta(days=int(e) // 86400) for e in epoch]
    rows["settled"] = [None if e % 3 == 0 else int(e) // 2 for e in rows["estimate"]]
    rows["settled_at"] = [None if s is None or pd.isna(s) else int(e) + 20 for s, e in zip(rows["settled"], epoch)]
    sent = spark.createDataFrame(
        [tuple(None if pd.isna(v) else (v if isinstance(v, datetime.date) else int(v)) for v in r) for r in rows.itertuples(index=False)],
        "run bigint, request_id bigint, epoch bigint, estimate bigint, day date, settled bigint, settled_at bigint",
    )
    got = {r["request_id"]: r["admitted"] for r in operations.admit_requests(sent, "run", limits).collect()}
    assert got == ledger_by_hand(rows, limits) and len(set(got.values())) == 2
    busy = operations.Limits(20_000, 4, 300, 7)  # no quiet window: all of a key hangs together, and every limit binds
    got = {r["request_id"]: r["admitted"] for r in operations.admit_requests(sent, "run", busy, chunk=23).collect()}
    assert got == ledger_by_hand(rows, busy) and len(set(got.values())) == 2


def test_sixteenth_request_in_a_minute_is_denied():
    ledger = operations.Ledger(operations.Limits())
    verdicts = [ledger.admit(1000 + i, "2024-01-01", 100, 70 + 30, 1000 + i) for i in range(16)]
    assert verdicts == [True] * 15 + [False] and ledger.admit(1061, "2024-01-01", 100, None, None)


def test_stages(spark):
    rows = spark.createDataFrame([("p", i, name, "passed" if i < 2 else "pending") for i, name in enumerate(["prepare", "looks", "credits_map", "map"])], "project string, place int, stage string, status string")
    row = rollups.first_incomplete(rows, ["project"], "place", "stage").first()
    assert (row["current"], row["passed_prefix"]) == ("credits_map", 2)


def test_chunked_scans_do_not_depend_on_chunks_or_partitions(spark):
    rows = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("p"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    results = []
    for size, parts in ((1000, 1), (7, 5), (1, 3)):
        source = rows.repartition(parts)
        chunk = chunks.position_chunk(F.col("p"), size)
        carried = chunks.carry_forward(source, ["k"], chunk, [F.col("p")], "v", "c")
        numbered = chunks.number_rows(carried, ["k"], chunk, [F.col("p")], "n")
        ahead = chunks.following(numbered, ["k"], chunk, [F.col("p")], "p", "next")
        rolled = chunks.trailing_aggregates(ahead, ["k"], "p", max(size, 10) if size < 1000 else 10, {"near": F.count("*")})
        results.append(sorted(tuple(r)[:-1] for r in rolled.collect()))
    assert results[0] == results[1] == results[2]


def test_chunked_scans_keep_null_keys_and_positions(spark):
    rows = spark.createDataFrame([(None, 1, 10), (None, 2, None), ("a", None, 5), ("a", 1, None), ("b", None, None)], "k string, p bigint, v bigint")
    chunk = chunks.position_chunk(F.col("p"), 2)
    carried = chunks.carry_forward(rows, ["k"], chunk, [F.col("p")], "v", "c")
    numbered = chunks.number_rows(carried, ["k"], chunk, [F.col("p")], "n")
    rolled = chunks.trailing_aggregates(numbered, ["k"], "p", 2, {"near": F.count("*")})
    got = {(r["k"], r["p"]): (r["c"], r["n"], r["near"]) for r in rolled.collect()}
    assert got == {(None, 1): (10, 1, 1), (None, 2): (10, 2, 2), ("a", None): (5, 1, 1), ("a", 1): (5, 2, 1), ("b", None): (None, 1, 1)}
    assert chunks.following(rows, ["k"], chunk, [F.col("p")], "p", "next").count() == 5
    marked = operations.stagnation(rows.withColumn("id", F.coalesce("p", F.lit(0))), ["k"], ["k"], "id", "id")
    assert sorted(r["stalled"] for r in marked.collect()) == [False, False, False, True, True]


def test_items_of_one_signature_get_one_answer(spark):
    pending = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "item int, q string")
    cache = spark.createDataFrame([], "signature string, result string, status string, result_sha256 string")
    answers = lambda misses: misses.select("signature", F.concat(F.lit("r"), "q").alias("result"), F.lit("ok").alias("status"))
    twice = lambda misses: answers(misses).unionByName(answers(misses))
    for decide in (answers, twice):
        got = sorted((r["item"], r["result"], r["status"]) for r in review.review_queue(pending, cache, decide, ["q"]).collect())
        assert got == [(1, "rx", "ok"), (2, "rx", "ok"), (3, "ry", "ok")]


def test_collisions_and_fingerprints_do_not_depend_on_size(spark, tmp_path):
    for name, content in (("a.jpg", b"1234"), ("b.jpg", b"1234"), ("c.jpg", b"12345")):
        (tmp_path / name).write_bytes(content)
    few, many = (sorted((r["name"], r["sha256"]) for r in assets.scan_collisions(spark, str(tmp_path), "*.jpg", broadcast_rows=n).collect()) for n in (10, 0))
    assert few == many and [h is None for _, h in few] == [False, False, True]
    rows = spark.range(7).select(F.lit(1).alias("g"), "id", F.col("id").cast("string").alias("v"))
    digest = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    for size in (3, 100):
        parts = [[str(i) for i in range(7) if i // size == c] for c in range(-(-7 // size))]
        assert rollups.fingerprint(rows, ["g"], "id", F.col("v"), F.floor(F.col("id") / size)).first()["fingerprint"] == digest([digest(p) for p in parts])


def small_events(spark, folder):
    spark.range(10).select(F.col("id").alias("event_id"), F.lit(1).cast("bigint").alias("user_id")).repartition(3).write.parquet(f"{folder}/events.parquet")


def test_streams_read_tables_of_many_files(spark, tmp_path):
    small_events(spark, tmp_path)
    assert jobs.drain(operations_catalog.table_stream(spark, str(tmp_path), "events")).count() == 10


def test_stagnation_stream_orders_a_key_across_arrow_batches(spark, tmp_path):
    spark.range(60).select(F.lit("r").alias("run"), (59 - F.col("id")).alias("snapshot_id"), ((59 - F.col("id")) % 7).alias("done")).coalesce(1).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        stream = spark.readStream.schema("run string, snapshot_id bigint, done bigint").parquet(str(tmp_path / "s"))
        got = jobs.drain(jobs.stagnation_stream(stream, "run", F.col("done").cast("string")))
        assert sorted(r["snapshot_id"] for r in got.where("NOT stalled").collect()) == list(range(7)) and got.count() == 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_upserts_survive_a_restart(spark, tmp_path):
    columns = "project int, look_id string, excel_sheet string, excel_look_number string, excel_image string, evidence_file string, visual_status string, note string"
    existing = spark.createDataFrame([(1, "LOOK_001", "W", "1", "", "", "PENDING", "", 0)], columns + ", manual_override int")
    spark.createDataFrame([(1, "LOOK_001", "W", "1", "", "", "CONFIRMED", "seen")], columns).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
        assert jobs.upsert_credits(stream, existing, ["project", "look_id"], str(tmp_path / "map")).first()["visual_status"] == "CONFIRMED"


def test_workbook_parts_and_cells_without_addresses(spark):
    out = io.BytesIO()
    main, office, package = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006/relationships"))
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="A" r:id="x"/><sheet name="B" r:id="y"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="x" Target="../xl/worksheets/one.xml"/><Relationship Id="y" Target="/xl/two.xml"/></Relationships>')
        book.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData><row><c><v>5</v></c><c t="b"><v>1</v></c></row><row r="4"><c r="C4"><v>6</v></c><c><v>7</v></c></row></sheetData></worksheet>')
        book.writestr("xl/two.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="AA2" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c></row></sheetData></worksheet>')
    books = spark.createDataFrame([("b.xlsx", out.getvalue())], "path string, content binary")
    got = sorted(tuple(r)[1:] for r in workbook.workbook_cells(books).collect())
    assert got == [("A", 1, 1, "n", "5"), ("A", 1, 2, "b", "1"), ("A", 4, 3, "n", "6"), ("A", 4, 4, "n", "7"), ("B", 2, 27, "s", "xy")]


def test_usage_comes_from_one_object(spark):
    payload = F.lit('{"usage": {"output_tokens": 5}, "usageMetadata": {"promptTokenCount": 9}}')
    row = spark.range(1).select(codes.usage_tokens(payload, codes.INPUT_FIELDS).alias("i"), codes.usage_tokens(payload, codes.OUTPUT_FIELDS).alias("o")).first()
    assert tuple(row) == (None, 5)


def test_strict_tsv(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_bytes("﻿look_id\tname\nLOOK_001\t x \nLOOK_002\t  \n".encode())
    got = files.read_strict_tsv(spark, str(path), ["look_id", "name"]).collect()
    assert [tuple(r) for r in got] == [("LOOK_001", "x"), ("LOOK_002", None)]
    with pytest.raises(Exception):
        files.read_strict_tsv(spark, str(path), ["look_id", "title"]).collect()
    with pytest.raises(ValueError):
        files.read_strict_tsv(spark, str(path), ["Look_id", "name"])  # the case of a header counts
    path.write_bytes('look_id\tname\nLOOK_001\t"two\nlines"\n'.encode())
    assert files.read_strict_tsv(spark, str(path), ["look_id", "name"]).first()["name"] == "two\nlines"


def test_damaged_evidence_counts_as_absent(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"gate": "map", "passed": true}')
    (tmp_path / "b.json").write_text('{"gate": ')
    assert [r["gate"] for r in files.read_evidence_json(spark, str(tmp_path), "gate string, passed boolean").collect()] == ["map"]


def test_usage_of_a_hot_key_equals_a_sliding_window(spark):
    rng = random.Random(3)
    held = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-200, 4_000, 7)]), rng.randint(0, 50), i) for i in range(1_500)]
    df = spark.createDataFrame(held, "k string, at bigint, tokens bigint, id bigint")
    used = {r["id"]: (r["n"], r["sum"]) for r in chunks.trailing_sums(df, ["k"], "at", 500, 300, {"n": F.lit(1), "sum": F.col("tokens")}).collect()}
    near = lambda a, b: a[0] == b[0] and (a[1] is b[1] if None in (a[1], b[1]) else a[1] - 500 < b[1] <= a[1])
    assert used == {a[3]: (sum(1 for b in held if near(a, b)), sum(b[2] for b in held if near(a, b))) for a in held}
    hot = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") % 80_000).alias("at"), F.lit(2).alias("tokens"))
    last = chunks.trailing_sums(hot, ["k"], "at", 86_400, 3_600, {"n": F.lit(1), "sum": F.col("tokens")}).agg(F.max("n"), F.max("sum"), F.count("*")).first()
    assert tuple(last) == (200_000, 400_000, 200_000)  # one window holds them all


def test_names_of_one_prefix_are_placed_over_many_ranges(spark):
    names = [f"{'Common' if i % 2 else 'COMMON'} prefix {i * 7_919 % 5_000:05}" for i in range(5_000)] + [None, "", "common"]
    found = rollups.casefold_positions(spark.createDataFrame([(n,) for n in names + names[:50]], "name string"), "name").collect()
    order = [None, *sorted((n for n in names if n is not None), key=lambda n: (n.lower(), n))]
    assert [r["name"] for r in sorted(found, key=lambda r: r["place"])] == order and [r["place"] for r in sorted(found, key=lambda r: r["place"])] == list(range(1, len(order) + 1))


def test_frame_moves_of_a_key_count_without_its_rows(spark, monkeypatch):
    """Null and unknown looks, looks with many moves (more than one run of copies), and looks without moves."""
    from proofloom.operators import checks

    monkeypatch.setattr(checks, "ROWS_AT_ONCE", 3)
    fine = ("DOWN", "STYLE", *[0.0] * 4, 5.0, 0.0, 9.0, 9.0)
    names = "look long, mode string, paragraph_alignment string, from_top double, from_left double, from_bottom double, from_right double, to_top double, to_left double, to_bottom double, to_right double"
    moves = spark.createDataFrame([(look, *fine) for look in [1, 2, 2, 3, *[4] * 7, None, None]], names)
    known = spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "look long")
    found = checks.check_frame_moves(moves, known, "look")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(2, "repeated")] * 2 + [(4, "repeated")] * 7 + [(3, "unknown look")] + [(4, "unknown look")] * 7 + [(None, "unknown look")] * 2, key=str)
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_plan_is_checked_in_one_join(spark):
    from proofloom.operators import checks

    names = "k long, orientation string, left_image_filename string, right_image_filename string, photo_adjustment_points string, plan_status string"
    ready = (checks.ORIENTATION, "a", "b", "0", "READY")
    plan = spark.createDataFrame([(1, *ready), (1, *ready), (2, "x", "b", "a", "nan", "DRAFT"), (3, *ready), (None, *ready)], names)
    pairs = spark.createDataFrame([(1, "b", "a"), (2, "b", "a"), (4, "a", "b"), (4, "a", "b"), (None, "a", "b")], "k long, left_filename string, right_filename string")
    found = checks.check_plan(plan, pairs, ["k"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(2, "orientation"), (2, "not ready"), (2, "shift"), (3, "photo pair"), (None, "photo pair"), (4, "no plan"), (4, "no plan"), (None, "no plan")], key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
