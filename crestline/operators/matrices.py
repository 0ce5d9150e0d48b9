"""Distances between blocks of vectors, as tasks work them out: products of matrices find what may be nearest, sums by coordinate decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: States that are compared with a block of references at once.
TILE = 64
#: The pivot of vectors that are odd: of another length than the pivots', or with a missing or infinite coordinate.
ODD = -1


def usable(vectors: list) -> np.ndarray:
    """Those vectors of the commonest length whose coordinates are all finite, as a matrix."""
    whole = [v for v in vectors if all(x is not None and np.isfinite(x) for x in v)]
    if not whole:
        return np.zeros((0, 0))
    lengths = [len(v) for v in whole]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n))
    return np.array([v for v in whole if len(v) == width], float)


def rows_of(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of vectors of a length without nulls, and these as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten()
    whole = np.ones(len(at), bool)
    if flat.null_count:
        whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(at), width).all(1)
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width)
    return at[whole], x[whole]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, summed up coordinate by coordinate as distance() does."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(x.shape[-1]):
            gap = x[..., k] - y[..., k]
            total += gap * gap
        return np.sqrt(total)


def _to_pivots(column: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors that aren't odd, distances to all pivots)."""
    if not len(pivots):
        return np.zeros(0, int), np.zeros((0, 0))
    at, x = rows_of(column, pivots.shape[1])
    far = np.empty((len(x), len(pivots)))
    for k, p in enumerate(pivots):
        far[:, k] = apart(x, p)
    fine = np.isfinite(far).all(1)
    return at[fine], far[fine]


def owner(pivots: np.ndarray, vector: str) -> Callable:
    """Batches with each vector's nearest pivot and the distance r to it; odd ones have ODD and no r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = _to_pivots(batch.column(vector), pivots)
            pivot, r = np.full(batch.num_rows, ODD, np.int32), np.full(batch.num_rows, np.nan)
            if len(at):
                pivot[at], r[at] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("id"), pa.array(pivot), pa.array(r, mask=pivot == ODD)], ["v", "id", "pivot", "r"])

    return run


def dealt(spans: list, size: int) -> tuple[dict, list, int]:
    """(first block and number of blocks by pivot, shells (pivot, low, high, blocks), number of blocks): small pivots share a block, large ones have several."""
    places, shells, blocks, room = {}, [], 0, 0
    for s in spans:
        if s["n"] >= size or s["pivot"] == ODD:
            salts = -(-s["n"] // size)
            places[s["pivot"]], blocks, room = (blocks, salts), blocks + salts, 0
        else:
            if s["n"] > room:
                blocks, room = blocks + 1, size
            places[s["pivot"]], room = (blocks - 1, 1), room - s["n"]
        first, salts = places[s["pivot"]]
        shells.append((s["pivot"], s["low"], s["high"], range(first, first + salts)))
    return places, shells, blocks


def sent(pivots: np.ndarray, shells: list, blocks: int) -> Callable:
    """Batches with the blocks that may hold a state's nearest reference; of odd states: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = _to_pivots(batch.column("vector"), pivots)
            wanted = np.ones((batch.num_rows, blocks), bool)
            if len(at):
                bound = far.min(1)
                here = np.zeros((len(at), blocks), bool)
                for pivot, low, high, span in shells:
                    if pivot == ODD:
                        here[:, span.start : span.stop] = True
                        continue
                    away = far[:, pivot]
                    slack = 1e-9 * (1 + away + bound)
                    here[:, span.start : span.stop] |= (~((low - away > bound + slack) | (away - high > bound + slack)))[:, None]
                wanted[at] = here
            ends = np.concatenate([[0], wanted.sum(1).cumsum()]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(wanted)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), lists], ["key", "vector", "blocks"])

    return run


def _best(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of y, distance) for each row of x: the least distance, NaN being the largest, and of equal ones the first row."""
    place, least = np.zeros(len(x), int), np.full(len(x), np.nan)
    fine_x, fine_y = np.isfinite(x).all(1), np.isfinite(y).all(1)
    at_x, at_y = np.flatnonzero(fine_x), np.flatnonzero(fine_y)
    by_hand = list(np.flatnonzero(~fine_x))
    if len(at_x) and len(at_y):
        good = y[at_y]
        with np.errstate(over="ignore", invalid="ignore"):
            square = (good * good).sum(1)
            turned = np.ascontiguousarray(np.vstack([-2 * good.T, square]))
        most, unit = square.max(), 16 * (x.shape[1] + 8) * np.finfo(float).eps
        for k in range(0, len(at_x), TILE):
            rows = at_x[k : k + TILE]
            part = x[rows]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = np.hstack([part, np.ones((len(part), 1))]) @ turned
                own = (part * part).sum(1)
                sound = np.isfinite(own + most) & (own + most < 1e290)
                limit = rough.min(1) + unit * (own + most) + 1e-290
            by_hand += list(rows[~sound])
            a, b = np.nonzero(rough[sound] <= limit[sound, None])
            rows = rows[sound]
            d = apart(x[rows[a]], good[b])
            order = np.lexsort((b, d, a))
            _, first = np.unique(a[order], return_index=True)
            picked = order[first]
            place[rows[a[picked]]], least[rows[a[picked]]] = at_y[b[picked]], d[picked]
    # what isn't finite is compared row by row
    for k in np.flatnonzero(~fine_y):
        d = apart(x, y[k])
        better = (d < least) | ((d == least) & (k < place)) | (np.isnan(d) & np.isnan(least) & (k < place))
        place[better], least[better] = k, d[better]
    for k in by_hand:
        d = apart(x[k], y)
        place[k] = 0 if np.isnan(d).all() else int(np.nanargmin(d))
        least[k] = d[place[k]]
    return place, least


def nearest(states: pa.Table, refs: pa.Table) -> pa.Table:
    """(key, d, id): each state's nearest reference in a block. As in distance(), vectors of other lengths or with nulls are at a null distance, which comes first."""
    if not (states.num_rows and refs.num_rows):
        return pa.table({"key": states["key"].slice(0, 0), "d": pa.array([], pa.float64()), "id": refs["id"].slice(0, 0)})
    refs = refs.take(pc.sort_indices(refs, sort_keys=[("id", "ascending")], null_placement="at_start"))
    n = states.num_rows
    place, d, known = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
    for width in pc.unique(pc.list_value_length(states["vector"])).to_pylist():
        at, x = rows_of(states["vector"], width)
        ref_at, y = rows_of(refs["v"], width)
        if len(ref_at) < refs.num_rows:  # some reference is at a null distance: the first of them
            gone = np.ones(refs.num_rows, bool)
            gone[ref_at] = False
            place[at] = gone.argmax()
        elif len(at):
            place[at], d[at] = _best(x, y)
            known[at] = True
    return pa.table({"key": states["key"], "d": pa.array(d, mask=~known), "id": refs["id"].take(pa.array(place))})
