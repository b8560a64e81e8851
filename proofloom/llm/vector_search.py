"""Nearest vectors by inner product with one vantage-point tree per shard.

Vectors are dealt to shards by a hash of their id.  A shard keeps its distinct vectors with the ids of each, in bands
of norms within a factor of ``BAND`` (one outlier does not spoil the others), each with a tree of its own.  A band is
lifted onto a sphere: a coordinate sqrt(M^2 - |x|^2), M its largest norm, makes the largest inner product the smallest
distance.  A tree node keeps a vantage point and, for its two halves, the least and largest distance to it; by the
triangle inequality a half is no nearer to a query than the gap between the query's distance and that range.  A half
is skipped when the gap exceeds ``factor`` times the k-th distance found so far: factor 1 is an exact search, a
smaller one skips more.  Distances only skip; what a leaf holds is ranked by exact inner product, ties by the
smallest id, and a half that could tie is opened.  Queries are packed into blocks, every block meets every shard
once, and a task holds one of each.  What the shards found is merged per query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written_table
from .common import record

NEIGHBOURS = 20
#: Exact search; recall at other factors is measured in the tests.
FACTOR = 1.0
SHARD_ROWS = 4_096
BLOCK_QUERIES = 4_096
LEAF = 256
#: Largest norm of a band over its smallest.
BAND = 4.0
#: Allowance for rounding, relative to the norms: so many units of the last place for every component.
SLACK = 16 * np.finfo(float).eps
#: Pairs of a query and a vector that are scored exactly in one go.
SCORED_PAIRS = 65_536
NO_ID = np.iinfo(np.int64).max


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple]]:
    """Order of the points and nodes (vantage, start, end, children, ranges) over that order.

    The vantage point is the one farthest from the node's first point; the halves split the order of distances
    in the middle, so equal points do not unbalance the tree.  A leaf has no children.
    """
    order = np.arange(len(points))
    nodes: list[tuple] = []
    todo = [(0, len(points), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][3][side] = number
        if end - start <= leaf:
            nodes.append((None, start, end, [], []))
            continue
        held = points[order[start:end]]
        far = held[np.argmax(((held - held[0]) ** 2).sum(axis=1))]
        distance = np.sqrt(((held - far) ** 2).sum(axis=1))
        by_distance = np.argsort(distance, kind="stable")
        order[start:end] = order[start:end][by_distance]
        distance = distance[by_distance]
        middle = (end - start) // 2
        ranges = [(distance[0], distance[middle - 1]), (distance[middle], distance[-1])]
        nodes.append((far, start, end, [0, 0], ranges))
        todo += [(start, start + middle, number, 0), (start + middle, end, number, 1)]
    return order, nodes


def search_tree(
    nodes: list[tuple], points: np.ndarray, queries: np.ndarray, k: int, factor: float, *,
    lift: float | None = None, least: np.ndarray | None = None, ids: np.ndarray | None = None, query_ids: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the positions of its k best points (-1: none) and their values; points visited.

    Values are inner products less half the squared norm, so the largest is nearest; with ``lift``, the squared radius
    of the sphere that the tree's points were lifted to, they are the inner products.  Ties go to the smaller id.
    ``ids`` has the smallest id of a point and its smallest other one (``NO_ID``: none); the query's own is left out.
    What is below ``least`` is not looked for.  All queries of a block walk the tree together, nearer half first for
    the majority of them.
    """
    many, width = queries.shape
    ids = np.column_stack([np.arange(len(points)), np.full(len(points), NO_ID)]) if ids is None else ids
    best, found, named = np.full((many, k), -np.inf), np.full((many, k), -1), np.full((many, k), NO_ID)
    least = np.full(many, -np.inf) if least is None else least
    norms, query_norms = np.sqrt((points**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    half = norms**2 / 2 if lift is None else np.zeros(len(points))
    radius = float(norms.max(initial=0.0)) if lift is None else np.sqrt(lift)
    rounding = SLACK * (width + 4)
    slack = rounding * (query_norms + radius) ** 2
    placed = queries if lift is None else np.column_stack([queries, np.zeros(many)])
    visited = 0

    def visit(asking: np.ndarray, start: int, end: int) -> None:
        value = queries[asking] @ points[start:end].T - half[start:end]
        error = rounding * (query_norms[asking, None] + (norms[start:end] if lift is None else 0)) * norms[start:end]
        if query_ids is not None:
            value[(ids[start:end, 0] == query_ids[asking, None]) & (ids[start:end, 1] == NO_ID)] = -np.inf
        cut = np.maximum(best[asking, -1], least[asking])
        if end - start > k:
            cut = np.maximum(cut, np.partition(value - error, end - start - k, axis=1)[:, end - start - k])
        one, place = np.nonzero((value + error >= cut[:, None]) & (value > -np.inf))
        if not len(one):
            return
        place += start
        exact = np.concatenate([
            (points[place[i : i + SCORED_PAIRS]] * queries[asking[one[i : i + SCORED_PAIRS]]]).sum(axis=1) for i in range(0, len(one), SCORED_PAIRS)
        ]) - half[place]
        name = ids[place, 0]
        if query_ids is not None:
            name = np.where(name == query_ids[asking[one]], ids[place, 1], name)
        held = np.unique(one)
        one = np.concatenate([one, np.repeat(held, k)])
        exact, name, place = (np.concatenate([new, old[asking[held]].ravel()]) for new, old in ((exact, best), (name, named), (place, found)))
        order = np.lexsort((name, -exact, one))
        starts = np.searchsorted(one[order], held)
        chosen = order[starts[:, None] + np.arange(k)]
        best[asking[held]], named[asking[held]], found[asking[held]] = exact[chosen], name[chosen], place[chosen]

    stack = [(0, np.arange(many), np.zeros(many))]
    while stack:
        number, asking, gap = stack.pop()
        reach = (query_norms[asking] ** 2 + (lift or 0.0) - (gap / factor) ** 2) / 2 + slack[asking]
        near = reach >= np.maximum(best[asking, -1], least[asking])
        asking = asking[near]
        if not len(asking):
            continue
        vantage, start, end, children, ranges = nodes[number]
        if vantage is None:
            visited += len(asking) * (end - start)
            visit(asking, start, end)
            continue
        distance = np.sqrt(((placed[asking] - vantage) ** 2).sum(axis=1))
        gaps = [np.maximum(np.maximum(low - distance, distance - high), 0.0) for low, high in ranges]
        first = 0 if (gaps[0] <= gaps[1]).mean() >= 0.5 else 1
        for side in (1 - first, first):
            stack.append((children[side], asking, np.maximum(gap[near], gaps[side])))
    return found, best, visited


def sound(vector) -> bool:
    """Whether a vector takes part: finite components, not all zero."""
    return vector is not None and len(vector) > 0 and None not in vector and bool(np.isfinite(v := np.asarray(vector, dtype=float)).all()) and bool(v.any())


def _packed(rows: DataFrame, number: str, size: int, build) -> tuple[DataFrame, int]:
    """One row per group of about ``size`` vectors with what ``build`` makes of (ids, vectors); the number of groups."""
    groups = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(number, F.pmod(F.xxhash64("id"), F.lit(groups)))

    def pack(held: pa.Table) -> pa.Table:
        ids = held["id"].to_numpy().astype(np.int64)
        vectors = np.array(held["vector"].to_pylist(), dtype=np.float64)
        order = np.argsort(ids, kind="stable")
        made = pickle.dumps(build(ids[order], vectors[order]), protocol=5)
        return pa.table({number: held[number].slice(0, 1), "packed": pa.array([made], pa.binary())})

    return dealt.groupBy(number).applyInArrow(pack, f"{number} bigint, packed binary"), groups


def index_vectors(rows: DataFrame, *, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """The index, the packed trees of each shard, largest norms first, over rows (id, vector), and the number of shards."""

    def build(ids: np.ndarray, vectors: np.ndarray):
        unique, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.ravel()
        owners = np.argsort(where, kind="stable")  # ids of equal vectors stay in order
        starts = np.searchsorted(where[owners], np.arange(len(unique) + 1))
        ids, spans = ids[owners], np.column_stack([starts[:-1], starts[1:]])
        last = np.maximum.reduceat(ids, spans[:, 0])
        others = np.minimum.reduceat(np.where(ids == np.repeat(ids[spans[:, 0]], np.diff(starts)), NO_ID, ids), spans[:, 0])
        names = np.column_stack([ids[spans[:, 0]], np.where(last == ids[spans[:, 0]], NO_ID, others)])
        norms = np.sqrt((unique**2).sum(axis=1))
        with np.errstate(divide="ignore"):
            band = np.floor(np.log(norms) / np.log(BAND))
        trees = []
        for number in np.unique(band)[::-1]:
            of = np.flatnonzero(band == number)
            lift = float((norms[of] ** 2).max())
            order, nodes = build_tree(np.column_stack([unique[of], np.sqrt(np.maximum(lift - norms[of] ** 2, 0.0))]), leaf)
            of = of[order]
            trees.append({"vectors": unique[of], "lift": lift, "nodes": nodes, "names": names[of], "spans": spans[of]})
        return {"trees": trees, "ids": ids}

    return _packed(rows, "shard", shard_rows, build)


def nearest_vectors(
    vectors: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k largest inner products of every query row with all other rows.

    ``is_query`` is a condition on the rows.  Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows without an id; all others must have one length.  A query leaves out every
    row of its own id.  An id asks once, however often its row is repeated; of several vectors the one that sorts
    first asks.  Ties go to the smaller id; repeated rows are ranked like rows of their own.  With fewer
    candidates than k all are returned, none for an empty table.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0.0))
    rows, _ = written_table(rows)
    index, shards = index_vectors(rows.select("id", "vector"), shard_rows=shard_rows, leaf=leaf)
    blocks, many = _packed(rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")), "block", block_queries, lambda ids, held: (ids, held))
    index, blocks = written_table(index)[0], written_table(blocks.withColumnRenamed("packed", "asking"))[0]

    def each(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    met = index.withColumn("block", each(many)).join(blocks.withColumn("shard", each(shards)), ["shard", "block"]).select("packed", "asking")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, asking in zip(batch.column(0), batch.column(1)):
                index, (query_ids, queries) = pickle.loads(tree.as_py()), pickle.loads(asking.as_py())
                least, spans, scores = np.full(len(queries), -np.inf), [], []
                for tree in index["trees"]:
                    places, values, _ = search_tree(
                        tree["nodes"], tree["vectors"], queries, k, factor, lift=tree["lift"], least=least, ids=tree["names"], query_ids=query_ids
                    )
                    spans.append(np.where(places[..., None] >= 0, tree["spans"][places], 0))
                    scores.append(values)
                    least = np.maximum(least, values[:, -1])
                spans, scores = np.concatenate(spans, axis=1), np.concatenate(scores, axis=1)
                out = ([], [], [])
                for query_id, held, values in zip(query_ids.tolist(), spans, scores):
                    ids, scored = [], []
                    for (a, b), score in zip(held.tolist(), values):
                        same = index["ids"][a:b]
                        same = same[same != query_id][:k]
                        ids.append(same)
                        scored.append(np.full(len(same), score))
                    ids, scored = np.concatenate(ids), np.concatenate(scored)
                    order = np.lexsort((ids, -scored))[:k]
                    out[0].append(np.full(len(order), query_id))
                    out[1].append(ids[order])
                    out[2].append(scored[order])
                yield record(query_id=(np.concatenate(out[0]), pa.int64()), vec_id=(np.concatenate(out[1]), pa.int64()), score=(np.concatenate(out[2]), pa.float64()))

    near = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
