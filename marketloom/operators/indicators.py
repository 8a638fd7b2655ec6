"""Technical indicators per ticker (row-based frames ordered by time), for series of any length.

Rolling and shifted columns see the rows next to a cut; exponential means are recursive over the whole
series. Both come from one pass over the sorted parts of ``series``. A mean is a linear recurrence,
so a cut run is reduced to a linear map of the state before it, and the states at the cuts
follow from the maps. The state after the last row of a ticker is enough to go on with new bars.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marketloom.functions.expressions import nan_to_null
from marketloom.operators.layout import Series
from marketloom.operators.series import PART, affine, joined, numbers, runs, sorted_parts, streamed, windows
from marketloom.operators.skew import spread_join
from marketloom.schemas import INDICATORS


@dataclass(frozen=True)
class Params:
    """Window lengths. ``lag`` < 0 reads the following row, as the reference's *_lag1 columns do;
    set it to +1 for a true lag that leaks nothing."""

    ema: int = 14
    sma: int = 14
    rsi: int = 14
    fast: int = 12
    slow: int = 26
    signal: int = 9
    momentum: int = 7
    volatility: int = 5
    horizon: int = 7
    lag: int = -1

    @property
    def back(self) -> int:
        return max(self.sma - 1, self.momentum, self.volatility, self.lag)

    @property
    def ahead(self) -> int:
        return max(self.horizon, -self.lag, 0)


# smallest weight kept for an old value after a gap; below it the old value cannot be seen in a double
_TINY = 1e-150
_NONE = np.zeros(0)
MEANS = ("ema", "fast", "slow", "up", "down", "signal")


@dataclass
class State:
    """What a ticker's next row needs: rows and observed prices so far, the last price and the last
    observed one, missing rows since then, rows with a signal line, the means, and of the last rows the
    prices, volumes and last observed prices."""

    rows: int = 0
    observed: int = 0
    last: float = np.nan
    fill: float = np.nan
    gap: int = 0
    live: int = 0
    means: dict[str, float] = field(default_factory=lambda: dict.fromkeys(MEANS, 0.0))
    closes: np.ndarray = field(default_factory=lambda: _NONE)
    volumes: np.ndarray = field(default_factory=lambda: _NONE)
    fills: np.ndarray = field(default_factory=lambda: _NONE)

    @property
    def returns(self) -> np.ndarray:
        return changes(self.fills[:-1], self.fills[1:])


def changes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(before == 0, np.nan, after / before - 1)


class Steps(NamedTuple):
    """The recurrences of a run, y = a * y + b for each mean, and the state its counts leave."""

    a: dict[str, np.ndarray]
    b: dict[str, np.ndarray]
    observed: np.ndarray
    live: np.ndarray
    signal_weight: np.ndarray
    returns: np.ndarray
    after: State


def _steps(close: np.ndarray, volume: np.ndarray, s: State, p: Params) -> Steps:
    """Null rows keep a mean (a=1, b=0); after g null rows an old mean has weight (1-alpha)^(g+1),
    renormalised against alpha, as pandas does."""
    n, seen = len(close), ~np.isnan(close)
    at = np.arange(n)
    observed = s.observed + np.cumsum(seen)
    place = np.maximum.accumulate(np.where(seen, at, -1))
    fill = np.where(place >= 0, close[place], s.fill)
    before = np.r_[-1, place[:-1]]
    gap = at - np.where(before >= 0, before, -1 - s.gap) - 1
    fill_before, last = np.r_[s.fill, fill[:-1]], np.r_[s.last, close[:-1]]
    first = seen & (observed == 1)
    a, b, price = {}, {}, np.where(seen, close, 0.0)
    for name, span in (("ema", p.ema), ("fast", p.fast), ("slow", p.slow)):
        alpha = 2 / (span + 1)
        with np.errstate(under="ignore"):
            old = np.maximum((1 - alpha) ** (gap + 1.0), _TINY)
        a[name] = np.where(first | ~seen, 1.0, old / (old + alpha))
        b[name] = np.where(first, 1.0, np.where(seen, alpha / (old + alpha), 0.0)) * price
    step = close - last
    for name, part in (("up", step), ("down", -step)):
        a[name] = np.full(n, 1 - 1 / p.rsi)
        b[name] = np.where(part > 0, part, 0.0) / p.rsi
    start, beta = max(p.fast, p.slow), 2 / (p.signal + 1)
    alive = observed >= start
    a["signal"] = np.where(alive, 1 - beta, 1.0)
    weight = np.where(seen & (observed == start), 1.0, np.where(alive, beta, 0.0))
    live = s.live + np.cumsum(alive)
    after = replace(
        s, rows=s.rows + n, observed=int(observed[-1]), last=float(close[-1]), fill=float(fill[-1]),
        gap=int(n - 1 - place[-1]) if place[-1] >= 0 else s.gap + n if s.observed else 0, live=int(live[-1]),
        closes=joined(s.closes, close, p.back), volumes=joined(s.volumes, volume, max(p.lag, 0)),
        fills=joined(s.fills, fill, p.volatility))
    return Steps(a, b, observed, live, weight, changes(fill_before, fill), after)


def _advance(close: np.ndarray, volume: np.ndarray, s: State, p: Params) -> tuple[dict[str, np.ndarray], Steps, State]:
    """All means of a run, its steps, and the state after it."""
    steps = _steps(close, volume, s, p)
    y = {m: affine(steps.a[m], steps.b[m], s.means[m]) for m in MEANS if m != "signal"}
    y["signal"] = affine(steps.a["signal"], steps.signal_weight * (y["fast"] - y["slow"]), s.means["signal"])
    return y, steps, replace(steps.after, means={m: float(v[-1]) for m, v in y.items()})


def _columns(close: np.ndarray, volume: np.ndarray, s: State, p: Params, wanted: set[str], close_ahead: np.ndarray,
             volume_ahead: np.ndarray) -> tuple[dict[str, np.ndarray], State]:
    y, steps, after = _advance(close, volume, s, p)
    n, seen = len(close), steps.observed
    macd = np.where(seen >= max(p.fast, p.slow), y["fast"] - y["slow"], np.nan)
    signal = np.where(steps.live >= p.signal, y["signal"], np.nan)

    def shift(x: np.ndarray, tail: np.ndarray, ahead: np.ndarray, k: int) -> np.ndarray:
        full = np.concatenate([np.full(max(0, k - len(tail)), np.nan), tail[max(0, len(tail) - max(k, 0)):], x,
                               ahead[:max(0, -k)], np.full(max(0, -k - len(ahead)), np.nan)])
        return full[max(0, -k):][:n]

    with np.errstate(divide="ignore", invalid="ignore"):
        old, later = shift(close, s.closes, close_ahead, p.momentum), shift(close, s.closes, close_ahead, -p.horizon)
        made = {
            "ema": lambda: np.where(seen >= p.ema, y["ema"], np.nan),
            "sma": lambda: windows(close, s.closes, p.sma, lambda w: w.mean(axis=1)),
            "rsi": lambda: np.where(s.rows + np.arange(n) + 1 >= p.rsi, np.where(
                y["down"] == 0, 100.0, 100 - 100 / (1 + y["up"] / y["down"])), np.nan),
            "macd": lambda: macd, "macd_signal": lambda: signal, "macd_diff": lambda: macd - signal,
            "daily_return": lambda: 100 * steps.returns,
            "momentum": lambda: np.where(old == 0, np.nan, (close - old) / old),
            "volatility": lambda: windows(steps.returns, s.returns, p.volatility, lambda w: w.std(axis=1, ddof=1)),
            "future_return": lambda: np.where(close == 0, np.nan, 100 * (later / close - 1)),
            "Close_lag1": lambda: shift(close, s.closes, close_ahead, p.lag),
            "Volume_lag1": lambda: shift(volume, s.volumes, volume_ahead, p.lag)}
        return {c: made[c]() for c in INDICATORS if c in wanted}, after


# ---------------------------------------------------------------- states at the cuts

_KINDS = ("rows long, observed long, last double, fill double, gap long, live long, means array<double>, "
          "closes array<double>, volumes array<double>, fills array<double>")
_EDGE = ("opens boolean, closes boolean, head array<double>, head_volumes array<double>, counts struct<"
         + _KINDS.replace(" ", ":").replace(",:", ",") + ">")


def _plain(s: State) -> dict:
    return {**s.__dict__, "means": [s.means[m] for m in MEANS],
            **{c: getattr(s, c).tolist() for c in ("closes", "volumes", "fills")}}


def _state(v: dict | None) -> State:
    """A state from a row; None is that of a new ticker."""
    if v is None:
        return State()
    v = {c: v[c] for c in State.__dataclass_fields__}
    lists = {c: np.array([np.nan if x is None else x for x in v[c] or []], float) for c in ("closes", "volumes", "fills")}
    return State(**{**v, **lists, "means": dict(zip(MEANS, v["means"])),
                    **{c: np.nan if v[c] is None else v[c] for c in ("last", "fill")}})


def _values(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    close = numbers(t["Close"])
    return close, numbers(t["Volume"]) if "Volume" in t.column_names else np.full(len(close), np.nan)


def _saved(t: pa.Table) -> State:
    """The saved state that came with the first row of a ticker."""
    return _state(t["_saved"][0].as_py() if "_saved" in t.column_names else None)


def _edges(parts: DataFrame, s: Series, p: Params) -> list:
    """The first and the last run of each part: rows at its beginning, counts and last rows, as if no row were before."""
    key = parts.schema[s.key].dataType
    layout = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField(s.key, key),
                           *T.StructType.fromDDL(_EDGE).fields])
    schema = to_arrow_schema(layout)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for r in runs(batches, s.key, 0):
            if r.first:
                if out and not (out[-1]["opens"] or out[-1]["closes"]):
                    out.pop()
                now, head = State(), (_NONE, _NONE)
                out.append({PART: r.part, s.key: r.key, "opens": r.opens_part})
            values = _values(r.rows)
            now = _steps(*values, now, p).after
            head = tuple(np.concatenate(x)[:p.ahead] for x in zip(head, values))
            out[-1] |= {"closes": r.ends_part, "head": head[0].tolist(), "head_volumes": head[1].tolist(), "counts": _plain(now)}
        yield pa.RecordBatch.from_pylist([x for x in out if x["opens"] or x["closes"]], schema=schema)

    rows = streamed(parts, s.key, s.time).mapInArrow(scan, layout).collect()  # two a part
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: r[PART])


def _follow(old: State, run: dict, p: Params) -> State:
    """Counts and last rows after a run, from those before it and those of the run alone."""
    new = _state(run["counts"])
    fills = np.where(np.isnan(new.fills), old.fill, new.fills)
    return replace(
        old, rows=old.rows + new.rows, observed=old.observed + new.observed, last=new.last,
        fill=new.fill if new.observed else old.fill,
        gap=new.gap if new.observed else old.gap + new.rows if old.observed else 0,
        closes=joined(old.closes, new.closes, p.back), volumes=joined(old.volumes, new.volumes, max(p.lag, 0)),
        fills=joined(old.fills, fills, p.volatility))


def _maps(parts: DataFrame, s: Series, p: Params, begin: dict[int, State], goes_on: dict) -> dict[int, dict]:
    """For each part whose last run goes on in the next: the live rows of that run, the products of its means, their
    sums from 0, and what the signal line takes from the fast and slow mean before the run."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, dict] = {}
        for r in runs(batches, s.key, 0):
            if r.part not in goes_on or r.key != goes_on[r.part]:
                continue
            if r.first:
                start = begin[r.part] if r.opens_part and r.part in begin else _saved(r.rows)
                now = replace(start, means=dict.fromkeys(MEANS, 0.0), live=0)
                product, of = dict.fromkeys(MEANS, 1.0), [0.0, 0.0]
            close, volume = _values(r.rows)
            y, steps, now = _advance(close, volume, now, p)
            for i, (m, sign) in enumerate((("fast", 1), ("slow", -1))):
                grown = product[m] * np.cumprod(steps.a[m])
                of[i] = float(affine(steps.a["signal"], sign * steps.signal_weight * grown, of[i])[-1])
            product = {m: product[m] * float(np.prod(steps.a[m])) for m in MEANS}
            out[r.part] = {PART: r.part, "live": now.live, "product": [product[m] for m in MEANS],
                           "sum": [now.means[m] for m in MEANS], "of": of}
        yield pa.RecordBatch.from_pylist(list(out.values()), schema=pa.schema(
            [(PART, pa.int32()), ("live", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("product", "sum", "of"))]))

    if not goes_on:
        return {}
    narrow = parts.select(PART, s.key, s.time, *[c for c in ("Close", "Volume", "_saved") if c in parts.columns])
    rows = streamed(narrow, s.key, s.time).mapInArrow(
        scan, f"{PART} int, live long, product array<double>, sum array<double>, of array<double>").collect()
    return {r[PART]: r.asDict() for r in rows}


def _at_cuts(parts: DataFrame, s: Series, p: Params, means: bool) -> tuple[dict[int, State], dict[int, tuple]]:
    """(state before the first run of each part whose ticker began in an earlier one; first prices and volumes
    behind the last run of each part whose ticker goes on)."""
    edges = _edges(parts, s, p)
    opens, closes = ({r[PART]: r for r in edges if r[side]} for side in ("opens", "closes"))
    order = sorted(opens)
    first = {}
    if "_saved" in parts.columns:  # of the runs at cuts
        wanted = [r[s.key] for r in edges]
        first = {r[0]: r[1] for r in parts.where(F.col(s.key).isin([k for k in wanted if k is not None]))
                 .groupBy(s.key).agg(F.first("_saved").alias("v")).collect()}
    start = {k: _state(v.asDict() if v is not None else None) for k, v in first.items()}
    begin: dict[int, State] = {}
    goes_on = {}
    for part, after in zip(order, order[1:]):
        run = closes[part]
        if run[s.key] == opens[after][s.key]:
            old = begin[part] if run["opens"] and part in begin else start.get(run[s.key], State())
            begin[after] = _follow(old, run, p)
            goes_on[part] = run[s.key]
    if means:
        maps = _maps(parts, s, p, begin, goes_on)
        for part, after in zip(order, order[1:]):
            if part in goes_on:
                run, m = closes[part], maps[part]
                old = begin[part] if run["opens"] and part in begin else start.get(run[s.key], State())
                now = {n: a * old.means[n] + b for n, a, b in zip(MEANS, m["product"], m["sum"])}
                now["signal"] += m["of"][0] * old.means["fast"] + m["of"][1] * old.means["slow"]
                begin[after] = replace(begin[after], means=now, live=old.live + m["live"])
    behind = {}
    for i, part in enumerate(order):
        head, head_v = _NONE, _NONE
        for after in order[i + 1:]:
            if len(head) >= p.ahead or opens[after][s.key] != closes[part][s.key]:
                break
            head, head_v = (np.concatenate([x, np.array([np.nan if v is None else v for v in opens[after][c]], float)])
                            for x, c in ((head, "head"), (head_v, "head_volumes")))
            if not opens[after]["closes"]:
                break
        if len(head):
            behind[part] = head[:p.ahead], head_v[:p.ahead]
    return begin, behind


# ---------------------------------------------------------------- operators

def _checked(panel: DataFrame, s: Series, p: Params, states: DataFrame | None) -> DataFrame:
    if min(p.ema, p.fast, p.slow, p.signal, p.rsi, p.volatility) < 2:
        raise ValueError("windows must have at least two rows")
    panel = nan_to_null(panel)
    if states is not None:
        saved = F.struct(*[F.col(f.name) for f in T.StructType.fromDDL(_KINDS).fields]).alias("_saved")
        panel = spread_join(panel, states.select(s.key, saved), [s.key])
    return sorted_parts(panel, s.key, s.time)


def add_indicators(panel: DataFrame, s: Series = Series(), p: Params = Params(),
                   columns: Sequence[str] = tuple(INDICATORS), states: DataFrame | None = None) -> DataFrame:
    """``panel`` (key, time, Close, [Volume, ...]) plus the requested indicator columns.

    NaN in a floating column counts as missing; a change relative to a price of zero is null. With ``states``
    (from ``indicator_states``) the panel holds only bars after those the states have seen."""
    unknown = set(columns) - set(INDICATORS)
    if unknown:
        raise ValueError(f"unknown indicators: {sorted(unknown)}")
    if "Volume_lag1" in columns and "Volume" not in panel.columns:
        raise ValueError("Volume_lag1 needs the column Volume")
    parts = _checked(panel, s, p, states)
    scanned = bool({"ema", "rsi", "macd", "macd_signal", "macd_diff"} & set(columns))
    begin, behind = _at_cuts(parts, s, p, scanned)
    wanted, base = set(columns), panel.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, s.key, p.ahead):
            if r.first:
                now = begin[r.part] if r.opens_part and r.part in begin else _saved(r.rows)
            ahead = _values(r.ahead)
            if r.ends_part and r.part in behind:
                ahead = behind[r.part]
            made, now = _columns(*_values(r.rows), now, p, wanted, *ahead)
            rows = r.rows.select(base)
            for c in columns:
                rows = rows.append_column(c, pa.array(made[c], from_pandas=True))
            yield from rows.combine_chunks().to_batches()

    out = T.StructType([*[parts.schema[c] for c in base], *[T.StructField(c, T.DoubleType()) for c in columns]])
    return streamed(parts, s.key, s.time).mapInArrow(run, out)


def indicator_states(panel: DataFrame, s: Series = Series(), p: Params = Params(),
                     states: DataFrame | None = None) -> DataFrame:
    """One row per ticker: what its next bar needs. Save it, and later bars need no history. Tickers of
    ``states`` without a bar in ``panel`` keep theirs."""
    parts = _checked(panel, s, p, states)
    begin, behind = _at_cuts(parts, s, p, True)
    layout = T.StructType([parts.schema[s.key], *T.StructType.fromDDL(_KINDS).fields])
    schema = to_arrow_schema(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, last = [], None
        for r in runs(batches, s.key, 0):
            if r.first:
                if last is not None:
                    done.append(last)
                now = begin[r.part] if r.opens_part and r.part in begin else _saved(r.rows)
            now = _advance(*_values(r.rows), now, p)[2]
            last = None if r.ends_part and r.part in behind else {s.key: r.key, **_plain(now)}
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        yield pa.RecordBatch.from_pylist(done + ([last] if last else []), schema=schema)

    made = streamed(parts, s.key, s.time).mapInArrow(run, layout)
    if states is None:
        return made
    idle = states.join(parts.select(s.key).distinct(), states[s.key].eqNullSafe(parts[s.key]), "left_anti")
    return made.unionByName(idle.select(*made.columns))
