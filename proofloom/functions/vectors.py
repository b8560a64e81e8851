"""Distances between feature vectors, as column expressions and as numpy blocks for tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slice:
    """Dimensions [start, stop) whose absolute differences count ``weight`` in total or each."""

    start: int
    stop: int
    weight: float
    mean: bool = True


def dimension_weights(slices: list[Slice]) -> list[float]:
    """One weight per dimension: a blend of L1 parts is a single weighted L1 distance."""
    weights = [0.0] * max(part.stop for part in slices)
    for part in slices:
        share = part.weight / (part.stop - part.start) if part.mean else part.weight
        for dimension in range(part.start, part.stop):
            weights[dimension] += share
    return weights


# The shares of colour, edge and silhouette, and of structure and appearance.
COLOUR, EDGE, SILHOUETTE = 0.42, 0.38, 0.20
STRUCTURE, APPEARANCE = 0.75, 0.25
HISTOGRAM_HALF, SUMMARY = 0.5, 0.4
# Card shares of colour, edge, silhouette, grid, signature; pair shares of view, appearance, context.
CARD_SHARES = (0.28, 0.24, 0.14, 0.22, 0.12)
BEST_VIEW, BEST_APPEARANCE, PAIR_CONTEXT = 0.985, 0.010, 0.005


def blended_weights(colour: int, edge: int, silhouette: int, histogram: int, summary: int) -> list[float]:
    """Weights for vectors laid out as the five parts in this order, given their lengths."""
    bounds = np.cumsum([0, colour, edge, silhouette, histogram, summary]).tolist()
    shares = [STRUCTURE * COLOUR, STRUCTURE * EDGE, STRUCTURE * SILHOUETTE, APPEARANCE * HISTOGRAM_HALF, APPEARANCE * SUMMARY]
    return dimension_weights(
        [Slice(bounds[i], bounds[i + 1], share, mean=i != 3) for i, share in enumerate(shares)]
    )


def weighted_l1(left: Column, right: Column, weights: list[float]) -> Column:
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    weighted = F.zip_with(gaps, F.lit(weights).cast("array<double>"), lambda gap, weight: gap * weight)
    return F.aggregate(weighted, F.lit(0.0), lambda total, part: total + part)


def pair_distance(card: Column, left: Column, right: Column, view: list[float], appearance: list[float]) -> Column:
    """Card against a two-photo look: score, the nearer side, both view distances and the context."""
    left_view, right_view = weighted_l1(card, left, view), weighted_l1(card, right, view)
    middle = F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    nearer = F.least(weighted_l1(card, left, appearance), weighted_l1(card, right, appearance))
    context = weighted_l1(card, middle, appearance)
    views = F.struct(left_view.alias("left_score"), right_view.alias("right_score"), nearer.alias("nearer"), context.alias("context"))
    return F.transform(
        F.array(views),
        lambda v: F.struct(
            (
                F.least(v["left_score"], v["right_score"]) * BEST_VIEW + v["nearer"] * BEST_APPEARANCE + v["context"] * PAIR_CONTEXT
            ).alias("score"),
            F.when(v["left_score"] <= v["right_score"], "LEFT").otherwise("RIGHT").alias("side"),
            v["left_score"].alias("left_score"), v["right_score"].alias("right_score"),
            v["nearer"].alias("appearance"), v["context"].alias("context"),
        ),
    )[0]


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two bit strings held as arrays of 64-bit words."""
    bits = F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0), lambda total, count: total + count)


def mean_gap(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap) / F.size(left)


class WeightedL1:
    """Metric for tiles: rows of targets by rows of candidates."""

    metric = True
    PIECE_ROWS, PIECE_COLUMNS = 32, 512

    def __init__(self, weights: list[float]):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.width = len(weights)

    def matrix(self, targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        if len(targets) <= self.width:
            rows = [np.abs(candidates - target) @ self.weights for target in targets]
            return np.stack(rows) if rows else np.zeros((0, len(candidates)))
        total = np.zeros((len(targets), len(candidates)))
        across = np.ascontiguousarray(candidates.T)
        # In pieces that the processor's cache holds through all dimensions.
        for top in range(0, len(targets), self.PIECE_ROWS):
            for left in range(0, len(candidates), self.PIECE_COLUMNS):
                piece = total[top : top + self.PIECE_ROWS, left : left + self.PIECE_COLUMNS]
                gap, summed = np.empty(piece.shape), np.zeros(piece.shape)
                for dimension, weight in enumerate(self.weights):
                    if weight:
                        np.subtract(targets[top : top + self.PIECE_ROWS, dimension, None], across[dimension, left : left + self.PIECE_COLUMNS], out=gap)
                        np.abs(gap, out=gap)
                        gap *= weight
                        summed += gap
                piece[:] = summed
        return total


class PageSignature:
    """Metric for tiles of page signatures: bits as 0 and 1, then tones in 0..255.

    Differing bits count 1024 each and the mean tone gap less than that, so pages are ordered by
    (bits, tone) and both can be read back from one number.
    """

    metric = True
    BIT = 1024

    def __init__(self, bits: int, tones: int):
        self.tones = WeightedL1([1.0 / tones] * tones)
        self.bits, self.width = bits, bits + tones

    def matrix(self, targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        one, other = targets[:, : self.bits], candidates[:, : self.bits]
        differing = one.sum(axis=1)[:, None] + other.sum(axis=1)[None, :] - 2 * (one @ other.T)
        return differing * self.BIT + self.tones.matrix(targets[:, self.bits :], candidates[:, self.bits :])


class LookPair:
    """Card against look for tiles; a look's vector is its left and right photo in one."""

    metric = False

    def __init__(self, view: list[float], appearance: list[float], adaptive: bool = False):
        self.view, self.appearance, self.adaptive = WeightedL1(view), WeightedL1(appearance), adaptive
        self.width = len(view)

    def matrix(self, targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        left, right = targets[:, : self.width], targets[:, self.width :]
        best = np.minimum(self.view.matrix(left, candidates), self.view.matrix(right, candidates))
        nearer = np.minimum(self.appearance.matrix(left, candidates), self.appearance.matrix(right, candidates))
        context = self.appearance.matrix((left + right) / 2, candidates)
        direct = best * BEST_VIEW + nearer * BEST_APPEARANCE + context * PAIR_CONTEXT
        return 0.5 * direct + 0.5 * nearer if self.adaptive else direct
