import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofloom.functions.vectors import PageSignature, WeightedL1, blended_weights
from proofloom.operators.matching import quarantine_assign
from proofloom.plans import assignment, auction, neighbours
from proofloom.plans.assignment import assign_one_to_one, cheapest_assignment
from proofloom.plans.neighbours import nearest, rank_of
from proofloom.sources import images

COLUMNS = {"block": "b", "target": "id", "candidate": "id", "vector": "v"}


def table_cost(costs):
    class Table:
        """Costs looked up by target and candidate number, both held in a one-number vector."""

        metric = False

        def __init__(self, costs):
            self.costs = np.asarray(costs, dtype=float)

        def matrix(self, targets, candidates):
            return self.costs[targets[:, 0].astype(int)[:, None], candidates[:, 0].astype(int)[None, :]]

    return Table(costs)


def best_total(costs):
    rows, columns = costs.shape
    return min(sum(costs[i, j] for i, j in enumerate(order)) for order in itertools.permutations(range(columns), rows))


def points(spark, rows, block=0):
    return spark.createDataFrame([(block, i, [float(x) for x in v]) for i, v in enumerate(rows)], "b bigint, id bigint, v array<float>")


@pytest.mark.parametrize("seed", range(30))
def test_kernel_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(1, 6)
    costs = np.round(rng.random((rows, rng.integers(rows, 7))), 2)
    held, pays = cheapest_assignment(costs)
    assert len(set(held)) == rows
    assert np.isclose(costs[np.arange(rows), held].sum(), best_total(costs))
    prices = np.zeros(costs.shape[1])
    prices[held] = pays - costs[np.arange(rows), held]
    assert (prices >= -1e-9).all()
    assert (costs + prices >= pays[:, None] - 1e-9).all()


@pytest.mark.parametrize("crowded", [False, True])
def test_large_block_route_gives_the_same_total(spark, crowded):
    rng = np.random.default_rng(5)
    right = rng.random((30, 6))
    left = rng.random((8, 6)) * 0.05 if crowded else right[:20] + rng.normal(0, 0.1, (20, 6))
    size = len(left)
    cost = WeightedL1([1.0] * 6)
    exact, _ = cheapest_assignment(cost.matrix(left.astype("float32").astype(float), right.astype("float32").astype(float)))
    expected = cost.matrix(left, right)[np.arange(size), exact].sum()
    rows = assign_one_to_one(points(spark, left), points(spark, right), cost, whole_block_pairs=0, **COLUMNS).collect()
    assert len(rows) == size and len({r["candidate"] for r in rows}) == size
    assert np.isclose(sum(r["cost"] for r in rows), expected, atol=1e-4)


def test_more_targets_than_candidates_leaves_targets_open(spark):
    cost = WeightedL1([1.0])
    for limit in (0, 1_000_000):
        rows = assign_one_to_one(points(spark, [[5], [1], [2]]), points(spark, [[1], [2]]), cost, whole_block_pairs=limit, **COLUMNS).collect()
        assert {r["target"]: r["candidate"] for r in rows} == {0: None, 1: 0, 2: 1}  # not the earlier id: the least cost


def test_tiles_give_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 7)
    monkeypatch.setattr(neighbours, "TARGET_TILE_ROWS", 5)
    rng = np.random.default_rng(1)
    centres = rng.random((4, 3)) * 10
    left = np.concatenate([c + rng.random((8, 3)) for c in centres]).astype("float32")
    right = np.concatenate([c + rng.random((20, 3)) for c in centres]).astype("float32")
    cost = WeightedL1([1.0, 2.0, 0.5])
    full = cost.matrix(left.astype(float), right.astype(float))
    a, b = points(spark, left), points(spark, right)
    got = {(r["target"], r["rank"]): r["candidate"] for r in nearest(a, b, cost, 3, pivots=4, **COLUMNS).collect()}
    order = np.argsort(full, axis=1, kind="stable")
    assert got == {(i, k + 1): order[i, k] for i in range(len(left)) for k in range(3)}
    named = a.withColumn("cand", F.lit(11).cast("bigint")).join(
        spark.createDataFrame([(i, float(full[i, 11])) for i in range(len(left))], "id bigint, c double"), "id"
    )
    ranks = {r["target"]: r["rank"] for r in rank_of(named, b, cost, named_cost="c", named_id="cand", pivots=4, **COLUMNS).collect()}
    assert ranks == {i: int(np.where(order[i] == 11)[0][0]) + 1 for i in range(len(left))}


def quarantine(spark, costs):
    costs = np.asarray(costs, dtype=float)
    rows = quarantine_assign(
        points(spark, [[i] for i in range(costs.shape[0])]), points(spark, [[i] for i in range(costs.shape[1])]), table_cost(costs), **COLUMNS
    ).collect()
    held = {r["target"]: r["candidate"] for r in rows}
    return {t: c for t, c in held.items() if c is not None}, {t // 2 + 1 for t, c in held.items() if c is None}


def matrix(size, entries):
    costs = np.full((size, size), 0.80)
    for (row, column), value in entries.items():
        costs[row, column] = value
    return costs


def test_quarantine_cases(spark):
    crossed = matrix(4, {(0, 0): 0.01, (1, 1): 0.02, (2, 2): 0.100, (2, 3): 0.101, (3, 2): 0.101, (3, 3): 0.100})
    assert quarantine(spark, crossed) == ({0: 0, 1: 1}, {2})
    decisive = matrix(4, {(i, i): (i + 1) / 100 for i in range(4)})
    assert quarantine(spark, decisive) == ({i: i for i in range(4)}, set())
    narrow = matrix(4, {(0, 0): 0.100, (0, 1): 0.101, (1, 1): 0.010, (2, 2): 0.020, (3, 3): 0.030})
    assert quarantine(spark, narrow) == ({i: i for i in range(4)}, set())
    assert quarantine(spark, [[0.10, 0.101, 0.8, 0.8], [0.101, 0.10, 0.8, 0.8]]) == ({}, {1})
    assert quarantine(spark, [[0.01], [0.8]]) == ({}, {1})


def test_kernel_is_least_cost_with_more_rows_than_columns():
    held, _ = cheapest_assignment(np.array([[10.0], [1.0]]))
    assert held.tolist() == [-1, 0]
    rng = np.random.default_rng(8)
    for _ in range(50):
        rows, columns = rng.integers(2, 7), rng.integers(1, 4)
        cost = rng.integers(0, 6, size=(rows, columns)).astype(float)
        held, _ = cheapest_assignment(cost)
        least = min(sum(cost[r, c] for c, r in enumerate(p)) for p in itertools.permutations(range(int(rows)), int(columns))) if rows >= columns else None
        if least is not None:
            served = held >= 0
            assert served.sum() == columns and cost[np.flatnonzero(served), held[served]].sum() == least


def offers_of(spark, costs):
    rows = [("p", 0, i, j, float(c)) for i, row in enumerate(costs) for j, c in enumerate(row) if np.isfinite(c)]
    return spark.createDataFrame(rows, "piece string, block bigint, target bigint, candidate bigint, cost double").repartition(3)


def check_optimal(costs, held, paid, slack=1e-9):
    """``paid``: cost plus price of every target; the prices prove the assignment, and nobody pays for what is left."""
    exact, _ = cheapest_assignment(costs)
    assert len(set(held)) == len(costs)
    own = costs[np.arange(len(costs)), held]
    assert np.isclose(own.sum(), costs[np.arange(len(costs)), exact].sum(), atol=1e-9)
    prices = np.zeros(costs.shape[1])
    prices[held] = np.asarray(paid) - own
    assert (prices >= -slack).all() and (costs + prices >= np.asarray(paid)[:, None] - slack).all()


@pytest.mark.parametrize("seed", range(40))
def test_auction_of_one_task_equals_the_kernel(seed):
    rng = np.random.default_rng(seed)
    rows, columns = int(rng.integers(1, 40)), 0
    columns = rows + int(rng.integers(0, 20))
    costs = [rng.random((rows, columns)), rng.integers(0, 6, (rows, columns)).astype(float), np.full((rows, columns), 0.3),
             np.abs(rng.normal(0, 0.01, (rows, 1)) - np.linspace(0, 1, columns))][seed % 4]
    bidder, item = np.nonzero(np.ones_like(costs))
    check_optimal(costs, *auction.solve_offers(bidder, item, costs.ravel()))


def test_auction_over_many_tasks_equals_the_kernel(spark, monkeypatch):
    monkeypatch.setattr(auction, "TASK_OFFERS", 10)  # two targets
    monkeypatch.setattr(auction, "COST_BITS", 6)  # a coarse grid: few rounds
    costs = np.array([[0, 1, 3, 3, 2], [0, 2, 3, 3, 3], [0, 1, 2, 2, 3], [3, 0, 3, 1, 2]], dtype=float)
    rows = sorted(auction.auction(offers_of(spark, costs)).collect(), key=lambda r: r["target"])
    assert [r["target"] for r in rows] == list(range(4)) and all(r["cost"] == costs[r["target"], r["candidate"]] for r in rows)
    check_optimal(costs, [r["candidate"] for r in rows], [r["pays"] for r in rows], slack=0.25)


@pytest.mark.parametrize("seed", range(200))
def test_bids_end_within_epsilon(seed):
    rng = np.random.default_rng(seed)
    bidders, items, epsilon, outside = int(rng.integers(1, 9)), int(rng.integers(1, 9)), int(rng.integers(1, 50)), 3_000
    costs = rng.integers(0, 1_000, (bidders, items))
    b, i = np.nonzero(np.ones((bidders, items)))
    found = auction.bid_among(b, i, costs.ravel(), np.zeros(items, dtype=np.int64), np.full(bidders, -1), np.zeros(bidders, dtype=np.int64), outside, epsilon)
    assert sorted(f[0] for f in found) == list(range(bidders)) and sum(f[1] >= 0 for f in found) == min(bidders, items)
    prices = np.zeros(items, dtype=np.int64)
    for _, won, price, _ in found:
        if won >= 0:
            prices[won] = price
    for bidder, won, price, pays in found:
        assert pays == (costs[bidder, won] + price if won >= 0 else outside)
        assert pays <= (costs[bidder] + prices).min() + epsilon


def test_auction_leaves_open_what_no_offer_serves(spark, monkeypatch):
    monkeypatch.setattr(auction, "COST_BITS", 10)
    costs = np.array([[1.0, np.inf], [2.0, np.inf], [5.0, 6.0]])
    held, pays = auction.solve_offers(np.array([0, 1, 2, 2]), np.array([0, 0, 0, 1]), np.array([1.0, 2.0, 5.0, 6.0]))
    assert held.tolist() == [0, -1, 1] and pays[1] == np.inf
    found = {r["target"]: (r["candidate"], r["cost"]) for r in auction.auction(offers_of(spark, costs)).collect()}
    assert found == {0: (0, 1.0), 1: (None, None), 2: (1, 6.0)}
    assert auction.auction(offers_of(spark, costs).limit(0)).count() == 0


def test_pieces_too_large_for_a_matrix_are_auctioned(spark, monkeypatch):
    rng = np.random.default_rng(6)
    size = 1_100  # one piece of 1.2 million pairs, but only a few offers a target
    chosen = np.stack([(np.arange(size) + step) % size for step in (0, 1, 17, 300)], axis=1)
    offers = spark.createDataFrame([("p", 0, i, int(j), 0.25) for i, held in enumerate(chosen) for j in held], "piece string, block bigint, target bigint, candidate bigint, cost double")
    rows = assignment._solve_pieces(offers).collect()
    assert len(rows) == len({r["candidate"] for r in rows}) == size and {r["cost"] for r in rows} == {0.25}
    assert max(r["pays"] for r in rows) < 0.25 + assignment.AUCTION_SLACK
    monkeypatch.setattr(assignment, "PIECE_PAIRS", 30)
    right, left = rng.random((24, 2)), rng.random((20, 2)) * 0.2
    cost = WeightedL1([1.0, 1.0])
    exact, _ = cheapest_assignment(cost.matrix(left.astype("float32").astype(float), right.astype("float32").astype(float)))
    rows = assign_one_to_one(points(spark, left), points(spark, right), cost, whole_block_pairs=0, **COLUMNS).collect()
    assert len({r["candidate"] for r in rows} - {None}) == len(left) == len(rows)
    assert np.isclose(sum(r["cost"] for r in rows), cost.matrix(left, right)[np.arange(len(left)), exact].sum(), atol=1e-5)


def test_tiles_visited_are_written_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 3)
    monkeypatch.setattr(neighbours, "CELLS_AT_ONCE", 2)
    rng = np.random.default_rng(5)
    points = rng.integers(0, 3, (60, 2)).astype(float)  # many equal costs
    rows = spark.createDataFrame([(0, i, p.tolist()) for i, p in enumerate(points)], "block long, id long, vec array<float>")
    cost = WeightedL1([1.0, 1.0])
    got = {(r["target"], r["rank"]): (r["candidate"], r["cost"]) for r in nearest(rows, rows, cost, 4, block="block", target="id", candidate="id", vector="vec", pivots=4).collect()}
    costs = cost.matrix(points, points)
    for target in range(60):
        for rank, candidate in enumerate(np.argsort(costs[target], kind="stable")[:4], 1):
            assert got[target, rank] == (candidate, costs[target, candidate])


def test_pictures_compared_by_their_pixels_equal_their_vectors():
    rng = np.random.default_rng(6)
    pictures = rng.integers(0, 256, (9, 64)).astype(float)
    cells = images.WIDTH * images.HEIGHT
    weights = rng.random(5 * cells + images.BINS**3 + 4 + images.WIDTH + images.HEIGHT)
    made = images.photo_features(np.stack([images._thumbnail(p.astype(np.uint8).tobytes(), 8, 8, 1, (images.WIDTH, images.HEIGHT)) for p in pictures]))
    whole = np.hstack([made[name] for name in images.MATCHED]).astype(np.float32).astype(float)
    got = images.PictureDistance(8, 8, 1, weights).matrix(pictures[:3], pictures)
    assert got.shape == (3, 9) and np.allclose(got, (np.abs(whole[:3, None] - whole[None]) * weights).sum(axis=2))


def pictures_of_patches(rng, n, *shape):
    """Pictures of a few shades, some of them equal and some nearly so."""
    drawn = rng.integers(0, 256, (n // 2, *shape))
    return np.concatenate([drawn, drawn[: n // 4], np.clip(drawn[n // 4 :][: n - n // 2 - n // 4] + 1, 0, 255)]).reshape(n, -1).astype(float)


@pytest.mark.parametrize("channels, size", [(1, (48, 72)), (3, (16, 24)), (4, (18, 28))])
def test_nearest_pictures_of_a_tile_need_few_distances(channels, size, monkeypatch):
    rng, cells = np.random.default_rng(8), size[0] * size[1]
    lengths = (cells * 3, cells, cells, images.BINS**3, 4 + sum(size))
    monkeypatch.setattr(images, "GRID", 2)
    pictures = pictures_of_patches(rng, 240, 8, 8, channels)
    for weights in (blended_weights(*lengths), rng.random(sum(lengths))):
        distance = images.PictureDistance(8, 8, channels, weights, size)
        whole = distance.matrix(pictures[::3], pictures)
        tile = distance.tile(pictures, None)
        vectors = distance._vectors(pictures)
        gaps = np.abs(vectors[::3, None] - vectors[None]) @ distance.weights
        assert np.allclose(whole, gaps)
        for step in (distance.COARSE, distance.FINE):
            sums = distance.sums(vectors, step)
            assert (np.abs(sums[::3, None] - sums[None]).sum(axis=2) <= whole + tile.ROUNDING * tile.weight).all()
        rows, columns, found = tile.nearest(pictures[::3], 3)
        assert (np.diff(rows) >= 0).all() and np.allclose(found, whole[rows, columns])
        assert len(set(zip(rows, columns))) == len(rows)
        assert len(rows) < whole.size / 3 or channels > 1  # not every pair; random colours are no smooth pictures
        needed = whole <= np.sort(whole, axis=1)[:, 2, None] - 1e-9
        assert {(r, c) for r, c in np.argwhere(needed)} <= set(zip(rows, columns))


@pytest.mark.parametrize("spread", [False, True])
def test_nearest_pictures_equal_those_of_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "TILE_ROWS", 16)
    monkeypatch.setattr(neighbours, "TARGET_TILE_ROWS", 8)
    rng, cells = np.random.default_rng(9), images.WIDTH * images.HEIGHT
    distance = images.PictureDistance(8, 8, 1, blended_weights(cells * 3, cells, cells, images.BINS**3, 4 + images.WIDTH + images.HEIGHT))
    pictures = np.concatenate([pictures_of_patches(rng, 60, 8, 8), np.full((12, 64), 255.0), np.zeros((12, 64))])
    rows = spark.createDataFrame([(i % 2, i, p.tolist()) for i, p in enumerate(pictures)], "b long, id long, v array<float>")
    got = {(r["target"], r["rank"]): (r["candidate"], r["cost"]) for r in nearest(rows, rows, distance, 3, pivots=0, spread_ties=spread, **COLUMNS).collect()}
    costs, ids = distance.matrix(pictures, pictures), np.arange(len(pictures))
    ties = neighbours._tie_break(ids, ids) if spread else np.zeros_like(costs, dtype=int)
    for target in ids:
        own = ids[ids % 2 == target % 2]
        best = own[np.lexsort((own, ties[target, own], costs[target, own]))[:3]]
        assert [got[target, rank][0] for rank in (1, 2, 3)] == best.tolist()
        assert np.allclose([got[target, rank][1] for rank in (1, 2, 3)], costs[target, best])


@pytest.mark.parametrize("pivots", [0, 3])
def test_tiles_are_compared_in_a_fixed_number_of_parts(spark, pivots):
    rows = points(spark, np.random.default_rng(10).random((40, 2)))
    left, right = (neighbours._standard(rows, "b", "id", "v", name) for name in ("target", "candidate"))
    left = left.withColumns({"limit_cost": F.lit(None).cast("double"), "limit_id": F.lit(None).cast("bigint")})
    pairs = neighbours._tile_pairs(left, right, WeightedL1([1.0, 1.0]), 2, pivots)
    pairs.collect()
    assert pairs.rdd.getNumPartitions() == neighbours.PARTS_PER_CORE * spark.sparkContext.defaultParallelism


def test_page_signatures_count_bits_and_tones():
    rng = np.random.default_rng(7)
    pages = np.hstack([rng.integers(0, 2, (8, 64)), rng.integers(0, 256, (8, 8))]).astype(float)
    bits, tones = np.abs(pages[:, None, :64] - pages[None, :, :64]).sum(axis=2), np.abs(pages[:, None, 64:] - pages[None, :, 64:]).mean(axis=2)
    assert (PageSignature(64, 8).matrix(pages, pages) == bits * 1024 + tones).all()


def test_contested_pair_keeps_its_cards_when_other_pairs_hold_copies(spark, tmp_path):
    """The second card of each pair is a copy of the first card of the other."""
    import duckdb
    from proofloom import catalog
    from proofloom.catalog import matching as queries

    zero, one = [0.0] * 64, [1.0] * 64
    rows = [(0, zero, 0), (1, zero, 0), (2, one, 0), (3, zero, 0), (4, one, 0), (5, zero, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.contested_matches(spark, str(tmp_path)).select("block", "target", "candidate", "cost").collect()
    assert sorted(tuple(r) for r in got) == sorted(duck.execute(catalog.ORACLES["contested_matches"]).fetchall())
