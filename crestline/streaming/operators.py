"""Structured Streaming twins: statistics, sessions of exceedances, counter increments and adaptive thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crestline.operators.tails import STATE, Adaptive, tail_of


def windowed_statistics(stream: DataFrame, timestamp: str, value: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, missing, least, largest and mean of a value by time window and keys; rows later than the watermark are dropped."""
    rows = stream.withWatermark(timestamp, late)
    x = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(F.window(timestamp, width), *keys).agg(F.count("*").alias("n"), F.count_if(x.isNull()).alias("missing"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean")).select(F.col("window.start").alias("window_start"), *keys, "n", "missing", "low", "high", "mean")


def exceedance_sessions(stream: DataFrame, timestamp: str, value: str, keys: list[str], threshold: float, gap: str, late: str = "10 minutes") -> DataFrame:
    """Episodes of a fixed-cadence stream: exceedances of a key closer than the gap form a session."""
    hits = stream.where((F.col(value) > threshold) & ~F.isnan(value)).withWatermark(timestamp, late)
    return hits.groupBy(F.session_window(timestamp, gap), *keys).agg(F.count("*").alias("size"), F.max(value).alias("max_value")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "size", "max_value")


#: Groups in which keys are worked through together, so that a batch costs as many calls as there are groups, not keys. A group's state grows with its keys.
BUCKETS = 1_024


def bucketed(stream: DataFrame, key: str, *columns: Column) -> DataFrame:
    """(_bucket, _key, columns): the groups of a whole-numbered key. Rows without a key have a group of their own."""
    k = F.col(key).cast("long")
    return stream.select(F.when(k.isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(k), F.lit(BUCKETS).cast("long"))).alias("_bucket"), F.coalesce(k, F.lit(0).cast("long")).alias("_key"), *columns)


def sorted_rows(parts: Iterator[pd.DataFrame], order: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows in order of key and order, their different keys, and where each begins."""
    rows = pd.concat(list(parts)).sort_values(["_key", order], kind="stable")
    keys, begins = np.unique(rows["_key"].to_numpy(), return_index=True)
    return rows, keys, begins


def named(bucket: int, rows: pd.DataFrame) -> np.ndarray:
    """The rows' keys as they came."""
    return rows["_key"].to_numpy() if bucket >= 0 else np.full(len(rows), None, object)


def held(state: GroupState, keys: np.ndarray, width: int = 1) -> np.ndarray:
    """width numbers of each key, NaN for a key that the state (sorted keys, their numbers) lacks."""
    out = np.full((len(keys), width), np.nan)
    if state.exists:
        known, values = (np.array(x) for x in state.get)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        here = known[at] == keys
        out[here] = values.astype(float).reshape(-1, width)[at[here]]
    return out


def hold(state: GroupState, keys: np.ndarray, values: np.ndarray) -> None:
    """Puts the keys' numbers into the state; other keys stay."""
    values = values.reshape(len(keys), -1)
    if state.exists:
        known, old = (np.array(x) for x in state.get)
        kept = ~np.isin(known, keys)
        keys, values = np.concatenate([known[kept], keys]), np.concatenate([old.astype(float).reshape(-1, values.shape[1])[kept], values])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
    state.update((keys.tolist(), values.ravel().tolist()))


def counter_increments(stream: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """(key, order, increment, reset): differences to a key's last row, carried from batch to batch."""
    schema = f"{key} long, {order} double, increment double, reset boolean"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, keys, begins = sorted_rows(parts, order)
        x = rows[counter].to_numpy(float)
        before = np.roll(x, 1)
        before[begins] = held(state, keys)[:, 0]
        change = x - before
        hold(state, keys, x[np.append(begins[1:], len(x)) - 1])
        yield pd.DataFrame({key: named(k[0], rows), order: rows[order].to_numpy(float), "increment": np.where(change >= 0, change, np.nan), "reset": change < 0})

    chosen = bucketed(stream, key, F.col(order).cast("double").alias(order), F.col(counter).cast("double").alias(counter))
    return chosen.groupBy("_bucket").applyInPandasWithState(step, schema, HELD, "append", GroupStateTimeout.NoTimeout)


#: What a stream holds of a group's keys.
HELD = "keys array<long>, numbers array<double>"


def time_steps(stream: DataFrame, key: str, order: str, timestamp: str) -> DataFrame:
    """(key, order, step): seconds since a key's row before, carried from batch to batch; 0 is a duplicate, less a step back. Null at the first row and around a missing time, as in the batch form."""
    schema = f"{key} long, {order} double, step double"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, keys, begins = sorted_rows(parts, order)
        at = rows["_at"].to_numpy(float)  # microseconds, which a double holds exactly
        before = np.roll(at, 1)
        before[begins] = held(state, keys)[:, 0]
        hold(state, keys, at[np.append(begins[1:], len(at)) - 1])
        yield pd.DataFrame({key: named(k[0], rows), order: rows[order].to_numpy(float), "step": (at - before) / 1e6})

    chosen = bucketed(stream, key, F.col(order).cast("double").alias(order), F.unix_micros(F.col(timestamp).cast("timestamp")).alias("_at"))
    return chosen.groupBy("_bucket").applyInPandasWithState(step, schema, HELD, "append", GroupStateTimeout.NoTimeout)


def lag_features(stream: DataFrame, key: str, order: str, value: str, lags: list[int], width: int) -> DataFrame:
    """(key, order, value, value__lag_k for each lag, value__mean of the width rows before): features of earlier rows only.

    A key's state is a ring of its last values, as many as the longest lag or the width; means leave out missing values.
    """
    names = [f"{value}__lag_{k}" for k in lags]
    schema = ", ".join([f"{key} long", f"{order} double", f"{value} double", *[f"{c} double" for c in names], f"{value}__mean double"])
    longest = max([width, *lags])

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, keys, begins = sorted_rows(parts, order)
        x = rows[value].to_numpy(float)
        ends, nth = np.append(begins[1:], len(x)), np.arange(len(keys))
        # each key's ring stands before its rows
        at = np.arange(len(x)) + longest * (np.repeat(nth, ends - begins) + 1)
        every, slots = np.full(len(x) + longest * len(keys), np.nan), np.arange(longest)
        every[at] = x
        every[(begins + longest * nth)[:, None] + slots] = held(state, keys, longest)
        hold(state, keys, every[(ends + longest * nth)[:, None] + slots])
        near = [every[at - g] for g in range(width, 0, -1)]
        total, n = sum(np.where(np.isnan(v), 0.0, v) for v in near), sum((~np.isnan(v)).astype(int) for v in near)
        means = np.divide(total, n, out=np.full(len(x), np.nan), where=n > 0)
        yield pd.DataFrame({key: named(k[0], rows), order: rows[order].to_numpy(float), value: x, **{c: every[at - g] for c, g in zip(names, lags, strict=True)}, f"{value}__mean": means})

    chosen = bucketed(stream, key, F.col(order).cast("double").alias(order), F.col(value).cast("double").alias(value))
    return chosen.groupBy("_bucket").applyInPandasWithState(step, schema, HELD, "append", GroupStateTimeout.NoTimeout)


def adaptive_thresholds(stream: DataFrame, key: str, order: str, value: str, fitted: DataFrame, train: str = "train", quantile: float = 0.9) -> DataFrame:
    """(key, order, value, threshold, exceeds) of the live rows: each key's adaptive tail threshold, as tails.adaptive_thresholds() gives it over the whole series.

    fitted has each key's base and unit, from tails.adaptive_bases() over training rows; a key that
    it lacks has a null threshold. Rows marked train come before a key's live ones and aren't
    judged: those over the base are where the threshold starts. A key's state has a fixed size.
    """
    schema = f"{key} long, {order} double, {value} double, threshold double, exceeds boolean"

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, keys, begins = sorted_rows(parts, order)
        known, columns = (state.get[0], state.get[1:]) if state.exists else ([], [[]] * STATE.count(", ") + [[]])
        models = dict(zip(known, zip(*columns, strict=True), strict=True))
        bases, units = rows["base"].to_numpy(float), rows["unit"].to_numpy(float)
        learned, x, cuts = rows[train].to_numpy(bool), rows[value].to_numpy(float), np.full(len(rows), np.nan)
        for name, begin, end in zip(keys.tolist(), begins, [*begins[1:], len(rows)], strict=True):
            if not np.isfinite(bases[begin]):
                continue
            model = Adaptive(float(bases[begin]), tail_of(quantile), unit=float(units[begin]), held=models.get(name))
            at = np.arange(begin, end)
            for v in x[at[learned[at]]].tolist():
                model.learn(v)
            live = at[~learned[at]]
            cuts[live] = [model.step(v) for v in x[live].tolist()]
            models[name] = model.state()
        if models:
            state.update(([*models], *map(list, zip(*models.values(), strict=True))))
        yield pd.DataFrame({key: named(k[0], rows), order: rows[order].to_numpy(float), value: x, "threshold": cuts, "exceeds": x > cuts})[~learned]

    fits = fitted.select(F.col(key).cast("long").alias("_key"), "base", "unit").where("_key is not null")
    chosen = bucketed(stream.where(F.col(value).isNotNull()), key, F.col(order).cast("double").alias(order), F.col(value).cast("double").alias(value), F.coalesce(F.col(train), F.lit(False)).alias(train))
    met = chosen.join(fits, (chosen["_key"] == fits["_key"]) & (chosen["_bucket"] >= 0), "left").drop(fits["_key"])
    columns = ", ".join(f"{name} array<{kind}>" for name, kind in (c.split(" ") for c in STATE.split(", ")))
    return met.groupBy("_bucket").applyInPandasWithState(step, schema, f"keys array<long>, {columns}", "append", GroupStateTimeout.NoTimeout)
