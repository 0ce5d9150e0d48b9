"""What tasks work out on packed exceedances: sorted positions of a series, or of a stretch of it, as one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from crestline.functions.draws import BITS, Texts, numbers


def theta_of_draws(at: np.ndarray, n: int, starts: np.ndarray, b: int, run_length: int) -> np.ndarray:
    """Clusters over exceedances of each replicate that has any. starts: (replicate, block); blocks of length b stand side by side until n samples are there, one that passes the end goes on at the beginning."""
    replicates, k = starts.shape
    out = np.arange(k) * b
    end = starts + np.minimum(b, n - out)
    s = np.stack([starts, np.zeros_like(starts)], 2)
    e = np.stack([np.minimum(end, n), np.maximum(end - n, 0)], 2)
    begin = np.stack([np.broadcast_to(out, starts.shape), out + n - starts], 2)
    i, j = np.searchsorted(at, s.ravel()), np.searchsorted(at, e.ravel())
    there = np.flatnonzero(j > i)
    i, j = i[there], j[there]
    shift = (begin.ravel() - s.ravel())[there]
    replicate = there // (2 * k)
    opened = np.concatenate([[0, 0], (np.diff(at) - 1 > run_length).cumsum()])[: len(at) + 1]  # clusters opened before a place, the first exceedance left out
    opens = opened[j] - opened[i + 1]
    first, last = at[i] + shift, at[j - 1] + shift
    apart = np.ones(len(there), bool)
    apart[1:] = (replicate[1:] != replicate[:-1]) | (first[1:] - last[:-1] - 1 > run_length)
    hits = np.bincount(replicate, j - i, replicates)
    clusters = np.bincount(replicate, opens + apart, replicates)
    return clusters[hits > 0] / hits[hits > 0]


def thetas(run_length: int, circular: bool) -> Callable:
    """Rows of a series' exceedances with the replicates to draw, as rows of the replicates' theta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[str]] = {}  # ends of the words of equal replicates and numbers of blocks
        for batch in batches:
            found = []
            for words, at, n, b, first, end in zip(*(batch.column(c).to_pylist() if c == "_words" else batch.column(c) if c == "_at" else batch.column(c).to_pylist() for c in ("_words", "_at", "_n", "_b", "_first", "_end")), strict=True):
                k = -(-n // b)
                if (first, end, k) not in known:
                    if len(known) >= 64 or k * (end - first) > 100_000:
                        known.clear()
                    known[first, end, k] = [f":{r}:{x}" for r in range(first, end) for x in range(k)]
                starts = numbers(words + x for x in known[first, end, k]) % (n if circular else max(1, n - b + 1))
                found.append(theta_of_draws(at.values.to_numpy(), n, starts.reshape(end - first, k), b, run_length))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), lists], ["_key", "thetas"])

    return run


def by_cell(positions: np.ndarray, size: int, max_lag: int) -> Iterator[tuple[int, bytes]]:
    """(cell, positions from the cell's begin), those just behind a cell, which are targets of it, once more for that cell."""
    kind = np.uint16 if size + max_lag <= 1 << 16 else np.uint32
    cell = positions // size
    inside = positions - cell * size
    for c in np.unique(cell):
        yield int(c), inside[cell == c].astype(kind).tobytes()
    behind = inside < max_lag
    for c in np.unique(cell[behind]):
        yield int(c) - 1, (inside[behind & (cell == c)] + size).astype(kind).tobytes()


def turned(n: int, first: int, last: int, size: int, max_lag: int) -> Callable:
    """Rows of a component's positions with a turn for each replicate, as rows of turned positions by cell, counted from the cell's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for component, at, turns in zip(batch.column("component"), batch.column("_at"), batch.column("_turns"), strict=True):
                at, made = at.values.to_numpy(), ([], [], [])
                low, high = int(at.min()), int(at.max())
                for replicate, turn in enumerate(turns.values.to_pylist()):
                    a, b = (low + turn) % n, (high + turn) % n
                    if a <= b and high - low < n and (b < first or a > last):
                        continue
                    moved = (at + turn) % n
                    for c, part in by_cell(moved[(moved >= first) & (moved <= last)], size, max_lag):
                        made[0].append(replicate)
                        made[1].append(c)
                        made[2].append(part)
                names = pa.array([component.as_py()] * len(made[0]), batch.schema.field("component").type)
                yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.int64()), names, pa.array(made[2], pa.binary())], ["replicate", "cell", "component", "at"])

    return run


def gaps_of(draws: np.ndarray, units: int) -> np.ndarray:
    """Exponential gaps in whole units, 1 at least, from numbers of BITS bits."""
    return np.floor(-np.log(1 - draws / float(1 << BITS)) * units).astype(np.int64) + 1


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.int64)


def drawn_runs(seed: int, units: int) -> Callable:
    """Rows of the runs of a component that start in a chunk of positions, with the replicates and the turns to keep, as rows of kept runs by replicate and range of turns.

    A run's turn says where in the random order it stands. Turns below _low are in range -1 with
    their sums alone, those from _high on are left out; range -1, which is always there, has the
    gaps of the whole chunk too. Starts are packed as the first one and the steps to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.field("component").type
            for component, chunk, runs, key, low, high, ranges, begin, end in zip(batch.column("component"), batch.column("_chunk").to_pylist(), batch.column("_runs"), *(batch.column(c).to_pylist() for c in ("_word", "_low", "_high", "_ranges", "_begin", "_end")), strict=True):
                starts, lengths = (runs.values.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(starts)
                starts, lengths = starts[order].astype(np.int64), lengths[order].astype(np.int64)
                texts, made = Texts(starts), []
                for replicate in range(begin, end):
                    turns = texts.numbers(f"{seed}:{key}:turn:{replicate}:")
                    gaps = gaps_of(texts.numbers(f"{seed}:{key}:gap:{replicate}:"), units)
                    place = np.where(turns < low, -1, np.where(turns >= high, ranges, (turns * (ranges / float(1 << BITS))).astype(np.int64)))
                    below = place < 0
                    made.append((replicate, -1, int(gaps.sum()), int(gaps[below].sum()), int(lengths[below].sum()), int(below.sum()), 0, 0, b"", b""))
                    for r in np.unique(place[~below]).tolist():
                        if r < ranges:
                            at = starts[place == r]
                            made.append((replicate, r, 0, 0, 0, 0, len(at), int(at[0]), packed(np.diff(at, prepend=at[0])), packed(lengths[place == r])))
                columns = list(zip(*made, strict=True))
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                parts = [pa.array([component.as_py()] * len(made), names), pa.array([chunk] * len(made), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(parts, ["component", "chunk", "replicate", "place", "all_gaps", "gaps", "lengths", "runs", "held", "first", "steps", "sizes"])

    return run


#: Positions of runs that are laid out at once.
LAID = 1 << 20


def placed_runs(seed: int, units: int, totals: dict, first: int, last: int, size: int, max_lag: int) -> Callable:
    """Rows of drawn_runs(), in order of component, replicate, range and chunk, as rows of positions by cell, as from turned().

    totals: component to (its word in draws, free samples, 1 if runs don't touch). A range of turns is in memory at a
    time. A replicate with runs between first and last outside the kept turns gives a row of replicate -1.
    """
    empty = lambda: {"all": 0, "gaps": 0, "lengths": 0, "runs": 0, "reached": None, "held": []}

    def laid(component, replicate, now: dict) -> Iterator[tuple]:
        """The runs of the range that is held."""
        word, free, apart = totals[component]
        if now["reached"] is None:
            now["all"] += int(gaps_of(numbers([f"{seed}:{word}:last:{replicate}:"]), units)[0])
            now["reached"] = _reached(now, free, apart)
            if now["runs"] and now["reached"] - apart > first:  # the end of the last run before the kept ones
                yield -1, -1, component, b""
        if not now["held"]:
            return
        starts, lengths = (np.concatenate(x) for x in zip(*now["held"], strict=True))
        now["held"] = []
        draws = [[x.numbers(f"{seed}:{word}:{what}:{replicate}:") for what in ("turn", "gap")] for x in map(Texts, np.array_split(starts, -(-len(starts) // 32_768)))]
        turns, gaps = (np.concatenate(x) for x in zip(*draws, strict=True))
        order = np.argsort(turns, kind="stable")
        gaps = np.cumsum(gaps_of(gaps, units)[order])
        lengths = lengths[order]
        ends = np.cumsum(lengths)
        at = np.floor(free * (now["gaps"] + gaps).astype(float) / now["all"]).astype(np.int64) + now["lengths"] + ends - lengths + apart * (now["runs"] + np.arange(len(starts)))
        now["gaps"], now["lengths"], now["runs"] = now["gaps"] + int(gaps[-1]), now["lengths"] + int(ends[-1]), now["runs"] + len(starts)
        begin, end = np.maximum(at, first), np.minimum(at + lengths - 1, last)
        begin, end = begin[begin <= end], end[begin <= end]
        counts = np.cumsum(end - begin + 1)
        for k in range(0, int(counts[-1]) if len(counts) else 0, LAID):
            which = np.arange(k, min(k + LAID, int(counts[-1])))
            run = np.searchsorted(counts, which, side="right")
            for cell, part in by_cell(end[run] - (counts[run] - 1 - which), size, max_lag):
                yield replicate, cell, component, part

    def closed(component, replicate, now: dict) -> Iterator[tuple]:
        yield from laid(component, replicate, now)
        word, free, apart = totals[component]
        if now["runs"] < now["whole"] and _reached(now, free, apart) <= last:  # the first run behind the kept ones is there or later
            yield -1, -1, component, b""

    def _reached(now: dict, free: int, apart: int) -> int:
        return int(np.floor(free * float(now["gaps"]) / now["all"])) + now["lengths"] + apart * now["runs"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, place, now = None, -1, empty()
        for batch in batches:
            for component, replicate, r, every, gaps, lengths, runs, whole, held, begin, steps, sizes in zip(*(batch.column(c).to_pylist() for c in ("component", "replicate", "place", "all_gaps", "gaps", "lengths", "runs", "whole", "held", "first", "steps", "sizes")), strict=True):
                if key != (component, replicate):
                    if key is not None:
                        yield from closed(*key, now)
                    key, place, now = (component, replicate), -1, empty() | {"whole": whole}
                if r != place:
                    yield from laid(*key, now)
                    place = r
                if r < 0:
                    for c, x in (("all", every), ("gaps", gaps), ("lengths", lengths), ("runs", runs)):
                        now[c] += x
                else:
                    now["held"].append((begin + np.cumsum(unpacked(steps, held)), unpacked(sizes, held)))
        if key is not None:
            yield from closed(*key, now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        batches = iter(batches)
        names = pa.string()

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal names
            for batch in batches:
                names = batch.schema.field("component").type
                yield batch

        def out() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), names, pa.binary()]
            columns = list(zip(*made, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["replicate", "cell", "component", "at"])

        for row in rows(seen()):
            made.append(row)
            if len(made) >= 512:
                yield out()
                made.clear()
        yield out()

    return run


def cell_lags(components: int, size: int) -> Callable:
    """Rows of two cells of a series, the second so many cells after the first, as counts of (source, target, lag) over all rows of the task that lie as far apart.

    A cell is an array of size * component + place. Products of Fourier transforms hold all lags; counts are
    whole numbers of at most size (times the square of repeats), so rounding makes them exact.
    """

    def placed(at: np.ndarray, n: int) -> np.ndarray:
        return np.fft.rfft(np.bincount(at // size * n + at % size, minlength=components * n).reshape(components, n).astype(float))

    def rows(sums: np.ndarray, apart: int) -> Iterator[pa.RecordBatch]:
        for s in range(components):
            t, k = np.nonzero(sums[s])
            columns = [np.full(len(t), s, np.int32), t.astype(np.int32), k + (apart - 1) * size, sums[s, t, k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source", "target", "lag", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((components, components, 2 * size), np.int64), None  # lags from size before to size after
        for batch in batches:
            for apart, *cells in zip(batch.column("apart").to_pylist(), batch.column("source"), batch.column("target"), strict=True):
                if held is not None and apart != held:
                    yield from rows(sums, held)
                    sums[:] = 0
                held = apart
                source, target = (c.values.to_numpy() for c in cells)
                half = 1 << int(max((source % size).max(), (target % size).max())).bit_length()  # over all places, so that no lag wraps
                a, b = placed(source, 2 * half), placed(target, 2 * half)
                reach = min(half, size)
                for s in range(components):
                    found = np.rint(np.fft.irfft(a[s].conj() * b, 2 * half)).astype(np.int64)
                    found[s] = 0
                    sums[s, :, size : size + reach] += found[:, :reach]
                    if apart:
                        sums[s, :, size - reach : size] += found[:, 2 * half - reach :]
        if held is not None:
            yield from rows(sums, held)

    return run


def lag_counts(size: int, max_lag: int) -> Callable:
    """Rows of a cell's positions by component, as counts of (replicate, source, target, lag) over all cells of the task."""
    kind = np.uint16 if size + max_lag <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, int] = {}
        names = pa.string()
        for batch in batches:
            names = batch.schema.field("parts").type.value_type.field("component").type
            for replicate, parts in zip(batch.column("replicate").to_pylist(), batch.column("parts"), strict=True):
                counts: dict = {}
                if replicate < 0:  # a mark, no cell
                    name = parts.as_py()[0]["component"]
                    sums[replicate, name, name, 0] = 1
                    continue
                for part in parts.as_py():
                    counts.setdefault(part["component"], []).append(np.frombuffer(part["at"], kind))
                seen = {c: np.bincount(np.concatenate(x), minlength=size + max_lag) for c, x in counts.items()}
                once = all(x.max() <= 1 for x in seen.values())
                if once:
                    seen = {c: x.astype(bool) for c, x in seen.items()}
                for s, a in seen.items():
                    for t, b in seen.items():
                        for lag in range(max_lag + 1) if s != t else ():
                            here, there = a[:size], b[lag : lag + size]
                            found = int(np.count_nonzero(here & there) if once else here @ there)
                            if found:
                                sums[replicate, s, t, lag] = sums.get((replicate, s, t, lag), 0) + found
        columns = list(zip(*[(*k, v) for k, v in sums.items()], strict=True)) or [()] * 5
        kinds = [pa.int32(), names, names, pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["replicate", "source", "target", "lag", "n"])

    return run
