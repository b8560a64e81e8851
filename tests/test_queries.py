"""Every registered query against its SQL on the smallest tables; the others against each other."""

import datetime
import math
import struct
import zlib
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from proofloom import catalog
from proofloom.functions.vectors import LookPair, WeightedL1
from proofloom.plans.assignment import cheapest_assignment
from proofloom.sources import images

catalog.load()
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, cursor.fetchall())


def collected(spark, name):
    return catalog.QUERIES[name](spark, FOLDER).collect()


def test_stream_admits_what_the_batch_admits(spark):
    batch, stream = (sorted(tuple(r) for r in collected(spark, name)) for name in ("admitted_requests", "streamed_admissions"))
    assert batch == stream and {r[-1] for r in batch} == {True, False}


def test_assigned_matches_are_optimal(spark, duck):
    from proofloom.catalog.matching import PHOTO_WEIGHTS

    rows = duck.execute("SELECT vec_id, label, embedding FROM embeddings").fetchall()
    found = {(r["block"], r["target"]): r for r in collected(spark, "assigned_matches")}
    cost = WeightedL1(PHOTO_WEIGHTS)
    for label in {r[1] for r in rows}:
        targets = sorted((r for r in rows if r[1] == label and r[0] % 3 == 0), key=lambda r: r[0])
        cards = sorted((r for r in rows if r[1] == label and r[0] % 3), key=lambda r: r[0])
        costs = cost.matrix(np.array([r[2] for r in targets]), np.array([r[2] for r in cards]))
        held, _ = cheapest_assignment(costs)
        mine = [found[(label, r[0])] for r in targets]
        assert len({m["candidate"] for m in mine}) == len(mine)
        assert np.isclose(sum(m["selected_score"] for m in mine), costs[np.arange(len(held)), held].sum(), atol=1e-4)
        for m, row in zip(mine, costs):
            assert m["rank"] == int((row < m["selected_score"] - 1e-6).sum()) + 1


def test_entry_summarises_every_match(spark):
    assert sum(r["matches"] for r in collected(spark, "match_verdicts")) == len(collected(spark, "assigned_matches"))


def test_one_to_one_cards_uses_a_card_once(spark):
    rows = [r for r in collected(spark, "one_to_one_cards") if r["candidate"] is not None]
    assert len({r["candidate"] for r in rows}) == len(rows)


def test_quarantined_looks_are_whole(spark):
    open_sides = {}
    for r in collected(spark, "quarantined_looks"):
        open_sides.setdefault((r["block"], r["target"] // 2), set()).add(r["candidate"] is None)
    assert all(len(sides) == 1 for sides in open_sides.values())


def test_distance_kernels_agree_in_both_shapes():
    rng = np.random.default_rng(0)
    weights = rng.random(5).tolist()
    many, few, cards = rng.random((9, 5)), rng.random((3, 5)), rng.random((4, 5))
    expected = (np.abs(many[:, None] - cards[None]) * weights).sum(axis=2)
    assert np.allclose(WeightedL1(weights).matrix(many, cards), expected)
    assert np.allclose(WeightedL1(weights).matrix(few, cards), (np.abs(few[:, None] - cards[None]) * weights).sum(axis=2))
    look = LookPair(weights, weights).matrix(np.concatenate([many, many], axis=1), cards)
    assert np.allclose(look, expected)  # equal photos: every part is the same distance


def png(pixels):
    height, width, _ = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files_become_features(spark, tmp_path):
    picture = np.full((72, 48, 3), 255, dtype=np.uint8)
    picture[18:54, 12:36] = (200, 0, 0)
    (tmp_path / "red.png").write_bytes(png(picture))
    row = images.image_features(images.read_images(spark, str(tmp_path)), "origin").first()
    assert np.isclose(np.mean(row["mask"]), 0.25) and np.isclose(row["histogram"][6 * 64], 1.0)
    assert np.allclose(row["summary"][:3], [200 / 255, 0, 0], atol=1e-6) and np.isclose(row["summary"][3], 0.25)
    adaptive = images.image_features(images.read_images(spark, str(tmp_path)), "origin", adaptive=True).first()
    assert np.isclose(np.mean(adaptive["mask"]), 0.25)


@pytest.mark.parametrize("name", ["workbook_cells", "parsed_observations", "product_blocks"])
def test_rows_with_much_work_are_dealt_over_the_cores(spark, name):
    from proofloom.catalog import PARTS_PER_CORE

    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    assert catalog.QUERIES[name](spark, FOLDER).rdd.getNumPartitions() == parts
