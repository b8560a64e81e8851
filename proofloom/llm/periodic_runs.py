"""Periodic runs of words: scale-tiled search and stitching of interval fragments.

A run is a stretch of words with smallest period q (words q apart are the same) that is at least ``max(MIN_LENGTH, 2 q)``
words long and that no neighbouring word extends keeping q.

  1. Tiles.  A document of more than ``TILE_WORDS`` words is cut, for every period octave [q, 2q), into tiles of 8q words
     that overlap by 4q (octaves below ``TILE_WORDS / 8`` share one set of tiles; a tile as long as the document serves all
     octaves above).  Every stretch of 2 periods lies in a tile, and so does what two tiles share of a run.
  2. A tile is solved alone: at boundaries half an octave apart, Z-functions of the tile against itself shifted by each period
     tell how far the words agree to the right and to the left.  Each stretch is taken at its first boundary.  Z values come
     from fingerprints of power-of-two windows; fragments found are compared word by word afterwards.
  3. Fragments are shuffled by (document, period).  Those that overlap by a period or more belong to one run.
  4. A word goes if a run holds it after the run's first period; only documents with fragments are read again for that.

Tiles are solved in the task that reads the document, but those of documents of more than ``LONG_CHARS`` characters are
dealt out first, so one document of any size keeps many tasks busy.

Defined cases: null or blank texts have no words and no runs.  Rows that are equal in id and text share a key and get equal
results.  ``rewrite`` gets the first ``keep`` column's value and the words (bytes), and may return others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written_table
from .common import record

MIN_LENGTH = 12
TILE_WORDS = 4_096
#: Documents of more characters have their tiles dealt over all tasks.
LONG_CHARS = 1_000_000
#: Words that a worker holds in tiles before it hands them on.
BATCH_WORDS = 500_000

FRAGMENT = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("period", pa.int64())])
_TILE = "n_words bigint, at bigint, least bigint, below bigint, codes array<int>, words binary"
_SOLVED = "n_words bigint, head boolean, words binary, collapsed string, fragments array<struct<start: bigint, stop: bigint, period: bigint>>"
_KEYS = ["_row", "_row2"]


def tiles_of(n: int, tile_words: int = TILE_WORDS) -> list[tuple[int, int, int, int]]:
    """(start, stop, least period, first period not sought) of the tiles of n words."""
    found, least, width = [], 1, tile_words
    while 2 * least <= n:
        if width >= n:
            return [*found, (0, n, least, n // 2 + 1)]
        below = width // 8 if least == 1 else 2 * least
        step = width - max(2 * below, MIN_LENGTH)
        found += [(at, min(at + width, n), least, below) for at in range(0, max(n - width, 0) + step, step) if at == 0 or at - step + width < n]
        least, width = below, 8 * below
    return found or [(0, n, 1, 1)]


@cache
def _prime_factors(size: int) -> np.ndarray:
    """A prime factor of every number below a power of two."""
    factor = np.arange(size)
    for p in range(2, int(size**0.5) + 1):
        if factor[p] == p:
            factor[p * p :: p] = p
    return factor


def _fingerprints(codes: np.ndarray, seed: int) -> list[np.ndarray]:
    """Fingerprints of the windows of 1, 2, 4, ... words that start at each word."""
    multiplier = np.uint64((0x9E3779B97F4A7C15 + 2 * seed) & (2**64 - 1))
    held = (codes.astype(np.uint64) + np.uint64(1)) * multiplier
    levels = [held ^ (held >> np.uint64(29))]
    while 2 << (len(levels) - 1) <= len(codes):
        half = 1 << (len(levels) - 1)
        held = (levels[-1][:-half] * np.uint64(0xBF58476D1CE4E5B9)) ^ (levels[-1][half:] >> np.uint64(3))
        held = (held + levels[-1][half:]) * multiplier
        levels.append(held ^ (held >> np.uint64(31)))
    return levels


def _agree(levels: list[np.ndarray], at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` words from ``at`` equal those ``shift`` further on; two windows cover any length."""
    same = np.ones(len(at), dtype=bool)
    level = np.frexp(np.maximum(length, 1))[1] - 1
    for j in np.unique(level[length > 0]):
        of = (level == j) & (length > 0)
        first, last = at[of], at[of] + length[of] - (1 << j)
        same[of] = (levels[j][first] == levels[j][first + shift[of]]) & (levels[j][last] == levels[j][last + shift[of]])
    return same


def _candidates(levels: list[np.ndarray], size: int, least: int, below: int) -> Iterator[np.ndarray]:
    """Maximal stretches (start, stop, period) within the tile, octave by octave, each once."""
    octave = least.bit_length() - 1
    while (1 << octave) < below:
        low, high = max(least, 1 << octave), min(below, 2 << octave)
        level = max(1, octave - 1)  # periods agree over as many words as they have: a window of half of that starts at a boundary
        step = 1 << level
        octave += 1
        bounds = np.arange(0, size - low - step + 1, step)
        if not len(bounds) or level >= len(levels):
            continue
        windows = levels[level]
        padded = np.concatenate([windows, np.zeros(high + step, dtype=np.uint64)])
        shifted = as_strided(padded[low:], (len(bounds), high - low), (step * 8, 8))
        row, column = np.nonzero(shifted == windows[: size - low - step + 1 : step, None])
        if not len(row):
            continue
        at, period = row * step, column + low
        inside = at + period + step <= size
        before = np.maximum(at - step, 0)
        first = (at < step) | (windows[before] != windows[np.minimum(before + period, len(windows) - 1)])
        at, period = at[inside & first], period[inside & first]
        start, end = at.copy(), at + step
        for j in range(level - 1, -1, -1):  # Z to the left of the boundary: less than a step, as the boundary is the first
            back = start - (1 << j)
            held = np.maximum(back, 0)
            start = np.where((back >= 0) & (levels[j][held] == levels[j][held + period]), back, start)
        for j in range(len(levels) - 1, -1, -1):  # Z to the right
            on = end + period + (1 << j) <= size
            last = len(levels[j]) - 1
            on &= levels[j][np.minimum(end, last)] == levels[j][np.minimum(end + period, last)]
            end = np.where(on, end + (1 << j), end)
        yield np.stack([start, end + period, period], axis=1)


def tile_fragments(codes: np.ndarray, least: int, below: int, seed: int = 0) -> np.ndarray:
    """Stretches (start, stop, period) of the tile with least <= smallest period < below that no word of the tile extends."""
    size = len(codes)
    below = min(below, size // 2 + 1)
    if least >= below or size < MIN_LENGTH:
        return np.zeros((0, 3), dtype=np.int64)
    levels = _fingerprints(codes, seed)
    found = np.concatenate([np.zeros((0, 3), dtype=np.int64), *_candidates(levels, size, least, below)])
    found = found[found[:, 1] - found[:, 0] >= np.maximum(MIN_LENGTH, 2 * found[:, 2])]
    if not len(found):
        return found
    factor, left = _prime_factors(1 << int(found[:, 2].max()).bit_length()), found[:, 2].copy()
    whole = np.ones(len(found), dtype=bool)  # no smaller period: one would divide this one
    while (left > 1).any():
        prime = np.where(left > 1, factor[left], 1)
        part = found[:, 2] // prime
        whole &= ~((prime > 1) & _agree(levels, found[:, 0], part, found[:, 2] - part))
        left //= prime
    found = found[whole]
    for start, stop, period in found.tolist():
        ends = (not start or codes[start - 1] != codes[start - 1 + period]) and (stop == size or codes[stop] != codes[stop - period])
        if not ends or (codes[start : stop - period] != codes[start + period : stop]).any():
            return tile_fragments(codes, least, below, seed + 1)  # two windows shared a fingerprint
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    values = pa.array(flat, kind) if flat.ndim == 1 else pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _tiled(kept: list[str], rewrite, tile_words: int):
    """Documents to rows of tiles; the first tile of a document carries its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows, held = [], [], 0
            texts = batch.column("_text").cast(pa.binary())
            first = batch.column(kept[0])
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").split()
                if rewrite is not None:
                    words = rewrite(first[i].as_py(), words)
                numbers: dict[bytes, int] = {}
                codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words))
                for place, (at, stop, least, below) in enumerate(tiles_of(len(words), tile_words)):
                    source.append(i)
                    rows.append((len(words), at, least, below, codes[at:stop], None if place else b" ".join(words)))
                    held += stop - at
                    if held >= BATCH_WORDS:
                        yield _tile_batch(batch, source, rows)
                        source, rows, held = [], [], 0
            if rows:
                yield _tile_batch(batch, source, rows)

    return run


def _tile_batch(batch: pa.RecordBatch, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
    n, at, least, below, codes, words = zip(*rows)
    keys = batch.drop_columns(["_text"]).take(pa.array(source))
    numbers = {name: (held, pa.int64()) for name, held in zip(("n_words", "at", "least", "below"), (n, at, least, below))}
    return record(**dict(zip(keys.schema.names, keys.columns)), **numbers, codes=_lists(list(codes), pa.int32()), words=(words, pa.binary()))


def _finished(words: bytes, with_text: bool) -> str:
    return words.decode(errors="replace") if with_text else hashlib.sha256(words).hexdigest()


def _solved(with_text: bool):
    """Rows of tiles to rows of fragments; a document of one tile and no fragment is finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = {name: batch.column(name).to_pylist() for name in ("n_words", "at", "least", "below")}
            held, codes, offsets = batch.column("words"), batch.column("codes"), batch.column("codes").offsets.to_numpy()
            flat = codes.values.to_numpy()
            words, collapsed, fragments = [], [], []
            for i, (n, at, least, below) in enumerate(zip(*head.values())):
                tile = flat[offsets[i] : offsets[i + 1]]
                found = tile_fragments(tile, least, below)
                found[:, :2] += at
                alone = len(tile) == n and not len(found)
                text = held[i].as_py()
                collapsed.append(_finished(text, with_text) if alone and text is not None else None)
                words.append(None if alone else text)
                fragments.append(found)
            names = [name for name in batch.schema.names if name not in ("at", "least", "below", "codes", "words")]
            yield record(
                **{name: batch.column(name) for name in names}, head=(held.is_valid().to_pylist(), pa.bool_()),
                words=(words, pa.binary()), collapsed=(collapsed, pa.string()), fragments=_lists(fragments, FRAGMENT),
            )

    return run


def stitched(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, start, period, length) from fragments (keys, period, start, stop): those that share a period or more are one."""
    of_period = Window.partitionBy(*keys, "period").orderBy("start", "stop")
    reached = F.max("stop").over(of_period.rowsBetween(Window.unboundedPreceding, -1))
    marked = fragments.distinct().withColumn("_new", F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True)).cast("int"))
    numbered = marked.withColumn("_run", F.sum("_new").over(of_period.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "period", "_run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length")).drop("_run")


def _collapsed(with_text: bool):
    """Words without what runs hold after their first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, runs in zip(batch.column("words"), batch.column("runs")):
                split, runs = words.as_py().split(), runs.as_py()
                edge = np.zeros(len(split) + 1, dtype=np.int64)
                for r in runs:
                    edge[r["start"] + r["period"]] += 1
                    edge[r["start"] + r["length"]] -= 1
                stay = (np.cumsum(edge[:-1]) == 0).tolist()
                out.append(_finished(b" ".join(w for w, kept in zip(split, stay) if kept), with_text))
            columns = {name: batch.column(name) for name in batch.schema.names if name != "words"}
            yield record(**columns, collapsed=(out, pa.string()))

    return run


def periodic_runs(
    docs: DataFrame, *, text: str = "text", keep: Iterable[str] = ("doc_id",), with_text: bool = True,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, tile_words: int = TILE_WORDS, long_chars: int = LONG_CHARS,
) -> DataFrame:
    """The ``keep`` columns, n_words, runs (array of start, period, length, in that order) and collapsed: the words that stay,
    joined by one space, or only their SHA-256 in hex."""
    kept = list(keep)
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    keys = "".join(f"`{name}` {types[name]}, " for name in kept) + "_row bigint, _row2 bigint, "
    rows = docs.select(*kept, F.xxhash64(*kept, text).alias("_row"), F.xxhash64(F.lit(1), *kept, text).alias("_row2"), F.col(text).alias("_text"))
    tiled, solve = _tiled(kept, rewrite, tile_words), _solved(with_text)
    long = F.coalesce(F.length("_text") > long_chars, F.lit(False))
    short = rows.where(~long).mapInArrow(lambda batches: solve(tiled(batches)), keys + _SOLVED)
    dealt = rows.where(long).mapInArrow(tiled, keys + _TILE).repartition(*_KEYS, "least", "at").mapInArrow(solve, keys + _SOLVED)
    solved, _ = written_table(short.unionByName(dealt))

    found = stitched(solved.select(*_KEYS, F.inline("fragments")), _KEYS)
    runs = found.groupBy(*_KEYS).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")
    heads = solved.where("head").select(*kept, *_KEYS, "n_words", "words", "collapsed")
    open_ = heads.where(F.col("collapsed").isNull()).drop("collapsed").join(runs, _KEYS, "left").drop(*_KEYS).withColumn("runs", F.coalesce("runs", none))
    schema = "".join(f"`{name}` {types[name]}, " for name in kept) + "n_words bigint, runs array<struct<start: bigint, period: bigint, length: bigint>>, collapsed string"
    closed = heads.where(F.col("collapsed").isNotNull()).select(*kept, "n_words", none.alias("runs"), "collapsed")
    return closed.unionByName(open_.mapInArrow(_collapsed(with_text), schema))
