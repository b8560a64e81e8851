"""Photographs to feature vectors; Spark decodes the files and spreads the work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Thumbnail size, luma shares, and the ramps that separate subject from background.
WIDTH, HEIGHT = 48, 72
LUMA = np.array([0.299, 0.587, 0.114])
PALE, PALE_RAMP, SPREAD, SPREAD_RAMP = 0.94, 0.24, 0.055, 0.18
ADAPTIVE, ADAPTIVE_RAMP = 0.025, 0.20
GRID, GRID_FLOOR, BINS, SMALL_BINS = 4, 0.08, 8, 4
PHOTOS_AT_ONCE = 256


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images under a path: origin, height, width, nChannels, data (blue, green, red)."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def _sampled(photos: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Centre crop of (n, height, width, colours) to the target shape, then bilinear sampling; 0..1."""
    height, width = photos.shape[1:3]
    target_width, target_height = size
    scale = min(width / target_width, height / target_height)
    crop_width, crop_height = target_width * scale, target_height * scale
    x = np.clip((width - crop_width) / 2 + (np.arange(target_width) + 0.5) * scale - 0.5, 0, width - 1)
    y = np.clip((height - crop_height) / 2 + (np.arange(target_height) + 0.5) * scale - 0.5, 0, height - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1)
    fx, fy = (x - x0)[:, None], (y - y0)[:, None, None]
    # A source line is sampled once, however many lines of the target lie beside it.
    lines, place = np.unique(np.concatenate([y0, y1]), return_inverse=True)
    held = photos[:, lines].astype(np.float64)
    across = held[:, :, x0] * (1 - fx) + held[:, :, x1] * fx
    return (across[:, place[:target_height]] * (1 - fy) + across[:, place[target_height:]] * fy) / 255.0


def _thumbnail(data: bytes, height: int, width: int, channels: int, size: tuple[int, int]) -> np.ndarray:
    """Centre crop to the target shape, then bilinear sampling; RGB in 0..1."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return _sampled((np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1])[None], size)[0]


def _ramp(values: np.ndarray, start: float, width: float) -> np.ndarray:
    """0 up to ``start``, 1 from ``start + width`` on."""
    return np.clip((values - start) / width, 0.0, 1.0)


def _frame_places(height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the four border lines; a corner lies on two of them."""
    across, down = np.arange(width), np.arange(height)
    rows = np.concatenate([np.repeat([0, height - 1], width), down, down])
    return rows, np.concatenate([across, across, np.repeat([0, width - 1], height)])


def subject_masks(photos: np.ndarray, grey: np.ndarray, adaptive: bool) -> np.ndarray:
    """How far each pixel of (n, height, width, 3) belongs to the subject."""
    if not adaptive:
        return np.maximum(_ramp(-grey, -PALE, PALE_RAMP), _ramp(np.ptp(photos, axis=3), SPREAD, SPREAD_RAMP))
    rows, columns = _frame_places(*grey.shape[1:])
    backdrop = np.median(photos[:, rows, columns], axis=1)
    return _ramp(np.abs(photos - backdrop[:, None, None]).max(axis=3), ADAPTIVE, ADAPTIVE_RAMP)


def colour_histograms(photos: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Weighted share of every colour cube per photo; zeros for a photo without weight."""
    levels = np.minimum(np.floor(photos * bins), bins - 1).astype(np.int64)
    cubes = np.ravel_multi_index(tuple(np.moveaxis(levels, 3, 0)), (bins,) * 3)
    own = cubes + bins**3 * np.arange(len(photos))[:, None, None]
    counts = np.bincount(own.ravel(), weights=weights.ravel(), minlength=len(photos) * bins**3).reshape(len(photos), -1)
    totals = counts.sum(axis=1, keepdims=True)
    return np.divide(counts, totals, out=np.zeros_like(counts), where=totals > 0)


def photo_features(photos: np.ndarray, adaptive: bool = False) -> dict[str, np.ndarray]:
    """Features of many photos of one size (n, height, width, 3), one row each.

    Structure (pixels, edges, mask, colour grid, signature) and appearance (histogram, summary).
    """
    n, height, width, _ = photos.shape
    grey = np.einsum("nhwc,c->nhw", photos, LUMA)
    edges = sum(np.abs(np.diff(grey, axis=axis, prepend=grey.take([0], axis=axis))) for axis in (1, 2))
    masks = subject_masks(photos, grey, adaptive)
    cells = np.maximum(masks, GRID_FLOOR).reshape(n, GRID, height // GRID, GRID, width // GRID)
    tinted = photos.reshape(*cells.shape, 3)
    grid = np.einsum("nahbw,nahbwc->nabc", cells, tinted) / cells.sum(axis=(2, 4))[..., None]
    profiles = np.hstack([masks.mean(axis=2), masks.mean(axis=1)])
    covered = masks.sum(axis=(1, 2))[:, None]
    colour = np.einsum("nhw,nhwc->nc", masks, photos) / np.maximum(covered, 1e-8)
    flat = lambda values: values.reshape(n, -1)
    return {
        "pixels": flat(photos), "edges": flat(edges), "mask": flat(masks), "grid": flat(grid),
        "signature": np.hstack([colour_histograms(photos, masks, SMALL_BINS), profiles]),
        "histogram": colour_histograms(photos, masks, BINS), "summary": np.hstack([colour, covered / (height * width), profiles]),
    }


FEATURES = ["pixels", "edges", "mask", "grid", "signature", "histogram", "summary"]
#: The parts of a match vector, in order.
MATCHED = ["pixels", "edges", "mask", "histogram", "summary"]


def image_features(images: DataFrame, identifier: str, adaptive: bool = False, size: tuple[int, int] = (WIDTH, HEIGHT)) -> DataFrame:
    """Feature arrays of decoded images (identifier, height, width, nChannels, data).

    Store the result and match on it; features are never recomputed per pair.
    """
    types = dict(images.dtypes)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), PHOTOS_AT_ONCE):
                part = batch.iloc[start : start + PHOTOS_AT_ONCE]
                photos = np.stack([_thumbnail(*photo, size) for photo in zip(part["data"], part["height"], part["width"], part["nChannels"])])
                made = photo_features(photos, adaptive)
                yield pd.DataFrame({identifier: part[identifier].to_numpy(), **{name: list(made[name].astype("float32")) for name in FEATURES}})

    fields = ", ".join(f"{name} array<float>" for name in FEATURES)
    needed = images.select(identifier, "height", "width", "nChannels", "data")
    return needed.mapInPandas(extract, f"{identifier} {types[identifier]}, {fields}")


def _grey_vectors(shades: np.ndarray) -> np.ndarray:
    """Match vectors of pictures (n, height, width) whose three colours are equal, with each colour, and each cube a grey can be in, once."""
    n = len(shades)
    # In the order in which the sum over three colours is made.
    grey = (shades * LUMA[0] + shades * LUMA[2]) + shades * LUMA[1]
    edges, across = np.zeros_like(grey), np.diff(grey, axis=2)
    np.subtract(grey[:, 1:], grey[:, :-1], out=edges[:, 1:])
    np.abs(edges, out=edges)
    edges[:, :, 1:] += np.abs(across, out=across)
    masks = _ramp(-grey, -PALE, PALE_RAMP)
    levels = np.minimum((shades * BINS).astype(np.int64), BINS - 1) + BINS * np.arange(n)[:, None, None]
    counts = np.bincount(levels.ravel(), weights=masks.ravel(), minlength=n * BINS).reshape(n, BINS)
    totals = counts.sum(axis=1, keepdims=True)
    shares = np.divide(counts, totals, out=np.zeros_like(counts), where=totals > 0)
    covered = masks.sum(axis=(1, 2))
    colour = np.einsum("nhw,nhw->n", masks, shades) / np.maximum(covered, 1e-8)
    flat = [values.reshape(n, -1) for values in (shades, edges, masks, shares, colour, covered / shades[0].size, masks.mean(axis=2), masks.mean(axis=1))]
    return np.concatenate(flat, axis=1, dtype=np.float32, casting="same_kind")


def _groups(length: int, step: int) -> np.ndarray:
    """What adds up ``step`` neighbours at a time, as a matrix."""
    return (np.arange(length)[:, None] // step == np.arange(-(-length // step))).astype(np.float32)


class PictureDistance:
    """Weighted L1 of the match vectors of pictures of one shape, which are given as their pixels.

    A match vector is hundreds of times longer than a small picture; it is made where a tile is compared and never travels.
    """

    metric = True
    PICTURES_AT_ONCE, COMPARED_AT_ONCE = 16, 8
    #: Sides of the squares of a thumbnail that the two bounds of a distance add up.
    COARSE, FINE = 12, 6

    def __init__(self, height: int, width: int, channels: int, weights: list[float], size: tuple[int, int] = (WIDTH, HEIGHT)):
        self.shape, self.size = (height, width, channels), size
        self.width = height * width * channels
        self.colours, self.cells = 1 if channels == 1 else 3, size[0] * size[1]
        self.weights = np.asarray(weights, dtype=np.float64)
        if self.colours == 1:
            colours, rest, cubes, summary, others = np.split(self.weights, np.cumsum([3 * self.cells, 2 * self.cells, BINS**3, 3]))
            greys = cubes[:: BINS**2 + BINS + 1]
            self.weights = np.concatenate([colours.reshape(-1, 3).sum(axis=1), rest, greys, [summary.sum()], others])

    def _vectors(self, pictures: np.ndarray) -> np.ndarray:
        made = np.empty((len(pictures), len(self.weights)), dtype=np.float32)
        for start in range(0, len(pictures), self.PICTURES_AT_ONCE):
            part = pictures[start : start + self.PICTURES_AT_ONCE].astype(np.uint8).reshape(-1, *self.shape)
            if self.colours == 1:
                made[start : start + len(part)] = _grey_vectors(_sampled(part, self.size)[..., 0])
            else:
                features = photo_features(_sampled(part[..., 2::-1], self.size))
                made[start : start + len(part)] = np.hstack([features[name] for name in MATCHED])
        return made

    def sums(self, vectors: np.ndarray, step: int) -> np.ndarray:
        """The weighted vectors with squares of the thumbnail, and neighbours elsewhere, added up.

        The L1 distance of two such sums is never more than the distance of the vectors, and little less where pictures are smooth.
        """
        n, (width, height), colours = len(vectors), self.size, self.colours
        weighted = vectors * self.weights.astype(np.float32)
        bounds = np.cumsum([colours * self.cells, self.cells, self.cells, BINS ** colours, colours + 1, height])
        pixels, edges, mask, cubes, summary, lines, columns = np.split(weighted, bounds, axis=1)
        down, across = _groups(height, step), _groups(width, step)
        apart = np.kron(across, np.eye(colours, dtype=np.float32))
        squares = [down.T @ (pixels.reshape(n, height, -1) @ apart), *(down.T @ (part.reshape(n, height, width) @ across) for part in (edges, mask))]
        cubes = cubes @ _groups(cubes.shape[1], BINS) if step == self.COARSE and colours > 1 else cubes
        return np.concatenate([*(part.reshape(n, -1) for part in squares), cubes, summary, lines @ down, columns @ across], axis=1)

    def costs(self, target: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Distances of one vector to some; the same for a pair wherever it stands."""
        gap = candidates.astype(np.float64)
        gap -= target
        return np.einsum("nd,d->n", np.abs(gap, out=gap), self.weights)

    def matrix(self, targets: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        costs = np.zeros((len(targets), len(candidates)))
        if not costs.size:
            return costs
        asking = self._vectors(targets)
        for start in range(0, len(candidates), self.PICTURES_AT_ONCE):
            held = self._vectors(candidates[start : start + self.PICTURES_AT_ONCE])
            for first in range(0, len(held), self.COMPARED_AT_ONCE):
                some, place = held[first : first + self.COMPARED_AT_ONCE], start + first
                for row, target in enumerate(asking):
                    costs[row, place : place + len(some)] = self.costs(target, some)
        return costs

    def tile(self, candidates: np.ndarray, copies: int | None) -> PictureTile:
        return PictureTile(self, candidates, copies)


def _distinct(pictures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every different picture, and the number of its picture for every row."""
    rows = np.ascontiguousarray(pictures.astype(np.uint8))
    _, first, number = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, number


class PictureTile:
    """Candidates that many targets are compared with: sums of their vectors rule out all but a few, whose distance is worked out.

    With ``copies`` only the first so many of equal pictures are found.
    """

    TARGETS_AT_ONCE, PIECE_COLUMNS, LIKELY, COSTS_AT_ONCE = 64, 512, 16, 8
    #: What rounding may add to the distance of sums, by the weight of the vectors.
    ROUNDING = 1e-4

    def __init__(self, distance: PictureDistance, candidates: np.ndarray, copies: int | None):
        self.distance = distance
        first, number = _distinct(candidates)
        self.rows, held = np.argsort(number, kind="stable"), np.bincount(number)
        self.starts, self.copies = np.cumsum(held) - held, np.minimum(held, copies or len(number))
        self.vectors = distance._vectors(candidates[first])
        parts = [self.vectors[start : start + self.TARGETS_AT_ONCE] for start in range(0, len(first), self.TARGETS_AT_ONCE)]
        self.coarse, self.fine = (np.concatenate([distance.sums(part, step) for part in parts]) for step in (distance.COARSE, distance.FINE))
        self.across, self.weight = np.ascontiguousarray(self.coarse.T), float(np.abs(self.fine).sum(axis=1).max())

    def nearest(self, targets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and distances, by row, of all pairs that may be among the k nearest of a target."""
        first, number = _distinct(targets)
        found = []
        for start in range(0, len(first), self.TARGETS_AT_ONCE):
            vectors = self.distance._vectors(targets[first[start : start + self.TARGETS_AT_ONCE]])
            coarse, fine = (self.distance.sums(vectors, step) for step in (self.distance.COARSE, self.distance.FINE))
            rounding = self.ROUNDING * max(self.weight, float(np.abs(fine).sum(axis=1).max()))
            for vector, sums, bounds in zip(vectors, fine, self._bounds(coarse)):
                places, costs = self._closest(vector, sums, bounds, min(k, len(self.vectors)), rounding)
                times = self.copies[places]
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found.append((self.rows[np.repeat(self.starts[places], times) + step], np.repeat(costs, times)))
        rows = np.repeat(np.arange(len(targets)), [len(found[i][0]) for i in number])
        return rows, *(np.concatenate([found[i][side] for i in number]) for side in (0, 1))

    def _bounds(self, coarse: np.ndarray) -> np.ndarray:
        """Distances of all coarse sums."""
        total = np.zeros((len(coarse), self.across.shape[1]), dtype=np.float32)
        # In pieces that the processor's cache holds through all dimensions.
        for left in range(0, total.shape[1], self.PIECE_COLUMNS):
            summed = np.zeros_like(total[:, left : left + self.PIECE_COLUMNS], order="C")
            gap = np.empty_like(summed)
            for dimension, held in enumerate(self.across[:, left : left + self.PIECE_COLUMNS]):
                np.subtract(coarse[:, dimension, None], held, out=gap)
                summed += np.abs(gap, out=gap)
            total[:, left : left + self.PIECE_COLUMNS] = summed
        return total

    def _closest(self, vector: np.ndarray, sums: np.ndarray, bounds: np.ndarray, k: int, rounding: float) -> tuple[np.ndarray, np.ndarray]:
        likely = min(max(k, self.LIKELY), len(bounds))
        places = np.argpartition(bounds, likely - 1)[:likely]
        places = places[np.argsort(np.abs(self.fine[places] - sums).sum(axis=1))[:k]]
        vector = vector.astype(np.float64)
        costs = self.distance.costs(vector, self.vectors[places])
        limit = costs.max()
        bounds[places] = np.inf
        left = np.flatnonzero(bounds <= limit + rounding)
        bounds = np.abs(self.fine[left] - sums).sum(axis=1)
        order = np.argsort(bounds)
        left, bounds = left[order], bounds[order]
        for start in range(0, len(left), self.COSTS_AT_ONCE):
            some = left[start : start + self.COSTS_AT_ONCE][bounds[start : start + self.COSTS_AT_ONCE] <= limit + rounding]
            if not len(some):
                break
            places, costs = np.concatenate([places, some]), np.concatenate([costs, self.distance.costs(vector, self.vectors[some])])
            limit = np.partition(costs, k - 1)[k - 1]
        return places, costs


def match_vector(features: DataFrame, identifier: str) -> DataFrame:
    """One vector per photo, laid out for ``functions.vectors.blended_weights``."""
    return features.select(identifier, F.concat(*MATCHED).alias("vector"))
