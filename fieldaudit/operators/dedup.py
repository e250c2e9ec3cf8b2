"""Greedy de-duplication in input order.

A point is kept unless an earlier *kept* point lies within ``r``.  Whether a point survives depends on
earlier decisions, so this is no window function: it is the first independent set, in input order, of
the radius graph.

Groups of any size take the same way, in three lazy passes.  Each pass streams its rows in order and remembers kept points
only, which are never dense:

* tiles of space decide what their own points and a margin of one radius allow.  A point that is not kept or dropped for
  certain stays open; cells with an open point hold later points near them open as well,
* tiles shifted by half their width do the same for what has been left open at the first tiles' edges,
* what is still open, chains of dependent points longer than a tile, is decided in order along each group, beside the kept points.

Nothing runs before an action, and no pass holds a group or a dense cell.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ
from ..session import cols, ship

#: Edge of a tile in radii, and rows that are decided at once.
TILE_CELLS, BLOCK_ROWS = 16, 1024
_OPEN, _DROPPED, _KEPT, _WAITING = -1, 0, 1, -2
_AROUND = np.array(list(product((-1, 0, 1), repeat=3)), np.int64)


def _keys(group: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A number per group and cell; equal numbers of different cells only add candidates for the exact test."""
    h = group.astype(np.uint64)
    for i in range(3):
        h = (h ^ cell[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place from ``low`` to ``high`` of each row."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _near(a: np.ndarray, b: np.ndarray, r: float) -> np.ndarray:
    d = a - b
    return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) <= r


class Walk:
    """Decides points block by block, in the order of their groups and in input order; remembers the last group's past."""

    def __init__(self, r: float):
        self.r = r
        self._forget(-1)

    def _forget(self, group: int) -> None:
        self.group, self.kept, self.at, self.open = group, np.zeros(0, np.uint64), np.zeros((0, 3)), np.zeros(0, np.uint64)

    def decide(self, group: np.ndarray, points: np.ndarray, known: np.ndarray, may_keep: np.ndarray) -> np.ndarray:
        """State per point; ``known`` ones are kept, those that may not be kept stay open where they aren't dropped."""
        n, r = len(group), self.r
        if not n:
            return np.zeros(0, np.int8)
        if group[0] != self.group:
            self._forget(int(group[0]))
        with np.errstate(invalid="ignore"):
            cell = np.floor(points / (r * (1 + 1e-9))).astype(np.int64)
        state = np.where(known, _KEPT, _WAITING).astype(np.int8)
        blocked = np.zeros(n, bool)
        own = _keys(group, cell)
        past = np.flatnonzero(group == self.group)
        for step in _AROUND if len(past) and (len(self.kept) or len(self.open)) else ():
            past = past[state[past] != _DROPPED]
            key = _keys(group[past], cell[past] + step)
            row, at = _spread(np.searchsorted(self.kept, key, "left"), np.searchsorted(self.kept, key, "right"))
            hit = past[row[_near(points[past[row]], self.at[at], r)]]
            state[hit[state[hit] == _WAITING]] = _DROPPED
            if len(self.open):
                blocked[past] |= self.open[np.minimum(np.searchsorted(self.open, key), len(self.open) - 1)] == key
        alive = np.flatnonzero(state != _DROPPED)
        order = alive[np.argsort(own[alive], kind="stable")]
        placed = own[order]
        later, earlier = [], []
        for step in _AROUND:
            key = _keys(group[alive], cell[alive] + step)
            row, at = _spread(np.searchsorted(placed, key, "left"), np.searchsorted(placed, key, "right"))
            row, at = alive[row], order[at]
            before = (at < row) & (group[at] == group[row])
            row, at = row[before], at[before]
            close = _near(points[row], points[at], r)
            later.append(row[close])
            earlier.append(at[close])
        row, at = np.concatenate(later), np.concatenate(earlier)
        while True:
            live = (state[row] == _WAITING) & (state[at] != _DROPPED)
            row, at = row[live], at[live]
            waits = np.zeros(n, bool)
            waits[row[state[at] == _WAITING]] = True
            held = blocked.copy()
            held[row[state[at] == _OPEN]] = True
            gone = row[state[at] == _KEPT]
            ready = (state == _WAITING) & ~waits
            state[ready] = np.where(may_keep[ready] & ~held[ready], _KEPT, _OPEN)
            state[gone] = _DROPPED
            if not (state == _WAITING).any():
                break
        last = group == group[-1]
        if group[-1] != self.group:
            self._forget(int(group[-1]))
        kept = last & (state == _KEPT)
        keys, at = np.append(self.kept, own[kept]), np.concatenate([self.at, points[kept]])
        order = np.argsort(keys, kind="stable")
        self.kept, self.at = keys[order], at[order]
        self.open = np.union1d(self.open, own[last & (state == _OPEN)])
        return state


def _decided(rows: DataFrame, r: float, groups, order: str) -> DataFrame:
    """The rows at home that are kept or open, with their new ``_state``; groups are streamed in order."""
    groups, names = list(groups), rows.columns

    def run(batches):
        walk, number, before = Walk(r), 0, None
        for batch in batches:
            change = np.zeros(batch.num_rows, bool)
            for c in groups:
                code = np.asarray(batch.column(names.index(c)).dictionary_encode(null_encoding="encode").indices)
                change[1:] |= code[1:] != code[:-1]
            edges = [tuple(batch.column(names.index(c))[i].as_py() for c in groups) for i in (0, -1)] if batch.num_rows else [before] * 2
            number += before is not None and edges[0] != before
            before = edges[1]
            group = number + np.cumsum(change)
            number = int(group[-1]) if len(group) else number
            points = np.stack([np.asarray(pc.cast(batch.column(names.index(a)), pa.float64()).to_numpy(zero_copy_only=False)) for a in XYZ], 1)
            known = batch.column(names.index("_state")).to_numpy(zero_copy_only=False) == _KEPT
            home = batch.column(names.index("_home")).to_numpy(zero_copy_only=False)
            state = [walk.decide(*(c[i : i + BLOCK_ROWS] for c in (group, points, known, home))) for i in range(0, len(group), BLOCK_ROWS)]
            state = np.concatenate(state) if state else np.zeros(0, np.int8)
            out = batch.set_column(names.index("_state"), "_state", pa.array(state.astype(np.int32)))
            yield out.filter(pa.array(home & (state != _DROPPED)))

    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, order)
    return ordered.mapInArrow(run, rows.schema)


def _tiled(points: DataFrame, r: float, by, order: str, tile_cells: int, shift: int) -> DataFrame:
    """One pass over tiles of ``tile_cells`` radii; a point also goes to the tiles whose margin it lies in."""
    d, home = points, F.lit(True)
    tiles = [f"_t{i}" for i in range(3)]
    for a, t in zip(XYZ, tiles, strict=True):
        cell = F.coalesce(F.floor(F.col(a) / F.lit(r * (1 + 1e-9))).cast("long"), F.lit(0)) + shift
        at = lambda c: F.floor(c / tile_cells).cast("long")
        d = d.withColumn(t, F.explode(F.sequence(at(cell - 1), at(cell + 1))))
        home = home & (F.col(t) == at(cell))
    return _decided(d.withColumn("_home", home), r, cols(by, tiles), order).drop(*tiles)


def greedy_dedup(points: DataFrame, r: float, by=("detector", "patch"), order: str = "alarm_ord", tile_cells: int = TILE_CELLS) -> DataFrame:
    """Rows of ``points`` that survive greedy de-duplication; ``r <= 0`` keeps every row.

    ``order`` must be unique within ``by``.  Points without coordinates are near nothing and are kept.
    """
    if r <= 0:
        return points
    ship(points.sparkSession)
    by = list(by)
    rows = points.withColumn("_state", F.lit(_OPEN).cast("int")).withColumn("_home", F.lit(True))
    for shift in (0, tile_cells // 2):
        rows = _tiled(rows, r, by, order, tile_cells, shift)
    return _decided(rows.withColumn("_home", F.lit(True)), r, by, order).drop("_state", "_home")
