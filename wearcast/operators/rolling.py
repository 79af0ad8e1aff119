"""Trailing ROWS-window statistics with the block method (WIN-1..8, WIN-12..15).

Spark re-aggregates a sliding frame for every row (O(rows x window)) and a
window partitioned only by the series key runs a whole series in one task.
Here a window of `w` rows ending at row `m` is split at the block border
(block = idx div w):

    window(m) = prefix of block b up to m  (+)  suffix of block b-1 from m-w+1

Both parts are running aggregates, the prefix in ascending order, the suffix
in descending order.  The suffix is evaluated at row m-w+1, so row m finds it
w-1 rows back.

All windows and lags of a table share one exchange on (keys, chunk): the rows
at the end of a chunk, as many as the longest look-back, are copied into the
next chunk.  Spark deals the chunks out and finds the lags; the statistics of
a chunk are numpy arrays over its rows (`block_windows`), which step through
the positions of a block for all blocks and columns at once, so the work per
row does not depend on the window.  A group holds one chunk and its halo.

Parts are merged with the pairwise (Chan et al.) update, so means,
variances and co-moments stay numerically stable:

    n = na + nb;  d = mb - ma;  mean = ma + d*nb/n
    M2 = M2a + M2b + d^2*na*nb/n;  C = Ca + Cb + dx*d*na*nb/n

The slope is C / Sxx with Sxx = n(n^2-1)/12 (consecutive positions).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import with_halo

CHUNK = 20160  # rows of a series that one group holds, the halo not counted
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Spec:
    name: str          # output prefix
    col: str           # input column
    stats: tuple = ("n", "mean", "m2", "min", "max")


def _running(y: np.ndarray, valid: np.ndarray, stats: set[str]) -> dict[str, np.ndarray]:
    """Running aggregates along the first axis (the positions in a block)."""
    out = {"n": np.cumsum(valid, axis=0, dtype=float)}
    total = np.cumsum(y, axis=0)
    if "sum" in stats:
        out["sum"] = total
    if "min" in stats:
        out["min"] = np.minimum.accumulate(np.where(valid, y, np.inf), axis=0)
    if "max" in stats:
        out["max"] = np.maximum.accumulate(np.where(valid, y, -np.inf), axis=0)
    if stats & {"mean", "m2", "slope"}:
        seen = np.maximum(out["n"], 1.0)
        out["mean"] = total / seen
    if stats & {"m2", "slope"}:
        sloped, held, here = "slope" in stats, valid.astype(float), y.shape[1:]
        avg, m2, mx, c = (np.zeros(here) for _ in range(4))
        for k in ("m2", "mx", "c")[:3 if sloped else 1]:
            out[k] = np.empty(y.shape)
        step = np.empty(here)
        for i in range(len(y)):
            d = (y[i] - avg) * held[i]
            np.divide(d, seen[i], out=step)
            avg += step
            np.subtract(d, step, out=step)
            m2 += d * step
            out["m2"][i] = m2
            if sloped:
                dx = (i - mx) * held[i]
                mx += dx / seen[i]
                c += dx * (y[i] - avg)
                out["mx"][i], out["c"][i] = mx, c
    return out


def block_windows(y: np.ndarray, valid: np.ndarray, w: int, stats: set[str], at: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of the windows of `w` positions that end at the positions `at`, for every row of
    y(columns, positions); the positions are a multiple of w.  Where a window has no valid value
    n is 0 and the others are not defined."""
    blocks = lambda a: a.reshape(len(a), -1, w).transpose(2, 0, 1)
    y = blocks(np.where(valid, y, 0.0))
    valid = blocks(valid)
    columns = len(y[0])
    flat = lambda a: a.transpose(1, 2, 0).reshape(columns, -1)
    a = {k: flat(v)[:, at] for k, v in _running(np.ascontiguousarray(y), np.ascontiguousarray(valid), stats).items()}
    back = at - (w - 1)
    has = (back >= 0) & (back % w != 0)          # at the last position of a block the prefix is the whole window
    back = np.where(has, back, 0)
    b = {k: flat(v[::-1])[:, back] for k, v in _running(np.ascontiguousarray(y[::-1]), np.ascontiguousarray(valid[::-1]), stats).items()}
    na, nb = a["n"], np.where(has, b["n"], 0.0)
    n = na + nb
    out, ratio = {"n": n}, nb / np.maximum(n, 1.0)
    both = lambda merged, k: np.where(nb == 0, a[k], np.where(na == 0, b[k], merged))
    if stats & {"mean", "m2", "slope"}:
        d = b["mean"] - a["mean"]
        out["mean"] = both(a["mean"] + d * ratio, "mean")
    if "m2" in stats:
        out["m2"] = both(a["m2"] + b["m2"] + d * d * na * ratio, "m2")
    if "min" in stats:
        out["min"] = np.where(nb == 0, a["min"], np.minimum(a["min"], b["min"]))
    if "max" in stats:
        out["max"] = np.where(nb == 0, a["max"], np.maximum(a["max"], b["max"]))
    if "sum" in stats:
        out["sum"] = both(a["sum"] + b["sum"], "sum")
    if "slope" in stats:
        # positions count from the prefix's block; the suffix was stepped through backwards from the end of the block before
        dx = (-1.0 - b["mx"]) - a["mx"]
        c = np.where(nb == 0, a["c"], np.where(na == 0, -b["c"], a["c"] - b["c"] + dx * d * na * ratio))
        out["slope"] = c / np.where(n > 1, n * (n * n - 1.0) / 12.0, 1.0)
    return out


def _chunk_stats(idx: str, columns: list[str], specs: dict[int, list[Spec]], schema: T.StructType):
    """The function that adds the statistics to the rows of one chunk."""
    from pyspark.sql.pandas.types import to_arrow_type
    keep = [f.name for f in schema.fields][:len(columns)]
    made = {f.name: to_arrow_type(f.dataType) for f in schema.fields[len(columns):]}
    top = max(specs)
    names = list(dict.fromkeys(s.col for group in specs.values() for s in group))

    def update(table: pa.Table) -> pa.Table:
        own = np.flatnonzero(~table.column("_halo").to_numpy())
        if table.column(idx).null_count:                 # rows without a place are in no window
            return pa.table({**{c: table.column(c) for c in keep}, **{n: pa.nulls(table.num_rows, t) for n, t in made.items()}})
        place = table.column(idx).to_numpy().astype(np.int64)
        lo = place.min() // top * top
        size = (place.max() // top + 1) * top - lo
        place = place - lo
        at = place[own]
        y, valid = np.zeros((len(names), size)), np.zeros((len(names), size), dtype=bool)
        for i, c in enumerate(names):
            v = table.column(c).cast(pa.float64()).to_numpy()           # null is NaN
            y[i, place], valid[i, place] = v, np.isfinite(v)
        out = {}
        for w, group in specs.items():
            for stats in dict.fromkeys(s.stats for s in group):          # columns with the same statistics in one step
                same = [s for s in group if s.stats == stats]
                of = [names.index(s.col) for s in same]
                found = block_windows(y[of], valid[of], w, set(stats), at)
                for k, s in enumerate(same):
                    n = found["n"][k]
                    for stat in s.stats:
                        gone = np.zeros(len(n), dtype=bool) if stat == "n" else n < (2 if stat == "slope" else 1)
                        v = np.where(gone, 0.0, found[stat][k])
                        out[f"{s.name}_{stat}"] = pa.array(v, mask=gone)
        rows = table.take(pa.array(own))
        return pa.table({**{c: rows.column(c) for c in keep}, **{n: out[n].cast(t) for n, t in made.items()}})

    return update


def rolling_windows(df: DataFrame, keys: list[str], idx: str, specs: dict[int, list[Spec]],
                    lags: dict[str, tuple[str, int]] | None = None, chunk_size: int = CHUNK) -> DataFrame:
    """Add `{name}_{stat}` columns for every window size `w` of `specs`: the
    trailing window of `w` rows ending at each row of the gap-free integer index
    `idx` (windows at the series start simply hold fewer rows; `{name}_n` is the
    count of values), and `lags` columns, `name = value of col at idx - k`.

    Every window size must divide the next larger one.  A null or non-finite
    value counts as missing.  Rows whose index is null get null statistics."""
    lags = lags or {}
    sizes = sorted(specs, reverse=True)
    if any(a % b for a, b in zip(sizes, sizes[1:])):
        raise ValueError(f"window sizes {sizes} do not divide one another")
    back = max([w - 1 for w in sizes] + [k for _, k in lags.values()])
    h = with_halo(df, idx, max(chunk_size, back), back).repartition(*keys, "_chunk")
    row = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    h = h.withColumns({n: F.when(F.lag(idx, k).over(row) == F.col(idx) - k, F.lag(c, k).over(row)) for n, (c, k) in lags.items()})

    types, kept = dict(df.dtypes), [*df.columns, *lags]
    made = []
    for w in sizes:
        for s in specs[w]:
            whole = types[s.col] in INTEGRAL
            of = {"n": T.LongType(), "sum": T.LongType() if whole else T.DoubleType(),
                  "min": df.schema[s.col].dataType, "max": df.schema[s.col].dataType}
            made += [T.StructField(f"{s.name}_{k}", of.get(k, T.DoubleType())) for k in s.stats]
    schema = T.StructType([*h.select(*kept).schema.fields, *made])
    return h.groupBy("_chunk", *keys).applyInArrow(_chunk_stats(idx, kept, {w: specs[w] for w in sizes}, schema), schema)


def rolling_block(df: DataFrame, keys: list[str], idx: str, w: int, specs: list[Spec]) -> DataFrame:
    """`rolling_windows` for one window size."""
    return rolling_windows(df, keys, idx, {w: specs})


def std_from(n: Column, m2: Column, ddof: int) -> Column:
    """Standard deviation from count and M2 (null when n <= ddof)."""
    return F.when(n > ddof, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - ddof)))
