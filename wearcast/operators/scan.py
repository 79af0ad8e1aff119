"""Distributed ordered-scan primitives.

A time series of one belt can hold a large share of all rows, so no
operator here uses a window partitioned by the series key alone (that
would put the whole series into one task).  Instead each series is cut
into chunks (a day of minutes, or a fixed number of readings):

* the per-row work runs in windows partitioned by (key, chunk);
* whatever must cross a chunk border is carried through a per-chunk
  summary table (one row per chunk) scanned with a small window;
* the carried values are joined back on (key, chunk).

The summary grows with (#series x #chunks), not with rows, so the
second-level window is cheap; AQE may broadcast it after measuring it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
FAN = 1024  # chunks whose summaries are scanned together


def _nn_struct(order: str, col: str) -> Column:
    return F.when(F.col(col).isNotNull(), F.struct(F.col(order).alias("o"), F.col(col).alias("v")))


def _carry_chunks(summary: DataFrame, keys: list[str], chunk: str, prev: dict[str, str], nxt: dict[str, str],
                  fan: int) -> DataFrame:
    """For each row of the chunk summary the last value of the earlier chunks
    (`prev`: new column -> (o, v) struct) and the first of the later ones.

    Chunks are grouped by `fan` again, so the window over a whole series sees
    one row for fan chunks: some thousand rows even for 10^12 readings."""
    s = summary.withColumn("_sup", F.floor(F.col(chunk) / fan).cast("long"))
    part = Window.partitionBy(*keys, "_sup")
    up = part.orderBy(F.col(chunk).asc()).rowsBetween(UNB, -1)
    dn = part.orderBy(F.col(chunk).desc()).rowsBetween(UNB, -1)
    near = s.withColumns({**{f"_near{n}": F.last(c, ignorenulls=True).over(up) for n, c in prev.items()},
                          **{f"_near{n}": F.last(c, ignorenulls=True).over(dn) for n, c in nxt.items()}})
    tops = s.groupBy(*keys, "_sup").agg(*[F.max(c).alias(n) for n, c in prev.items()], *[F.min(c).alias(n) for n, c in nxt.items()])
    whole = Window.partitionBy(*keys)
    far = tops.select(*keys, "_sup",
                      *[F.last(n, ignorenulls=True).over(whole.orderBy(F.col("_sup").asc()).rowsBetween(UNB, -1)).alias(f"_far{n}") for n in prev],
                      *[F.last(n, ignorenulls=True).over(whole.orderBy(F.col("_sup").desc()).rowsBetween(UNB, -1)).alias(f"_far{n}") for n in nxt])
    return near.join(far, [*keys, "_sup"], "left").select(
        *keys, chunk, *[F.coalesce(f"_near{n}", f"_far{n}").alias(n) for n in (*prev, *nxt)])


def carry_prev_next(df: DataFrame, keys: list[str], order: str, cols: list[str], chunk: str,
                    prev: bool = True, nxt: bool = True, fan: int = FAN) -> DataFrame:
    """For every row and column `c` add

    * `_p_c`: struct(o, v) of the last non-null `c` at or before the row,
    * `_n_c`: struct(o, v) of the first non-null `c` strictly after the row,

    across the whole ordered series of `keys` (nulls are skipped per column).
    """
    part = Window.partitionBy(*keys, chunk)
    w_up = part.orderBy(F.col(order).asc()).rowsBetween(UNB, 0)
    w_dn = part.orderBy(F.col(order).desc()).rowsBetween(UNB, -1)
    local = {}
    aggs = []
    for c in cols:
        s = _nn_struct(order, c)
        if prev:
            local[f"_pl_{c}"] = F.last(s, ignorenulls=True).over(w_up)
            aggs.append(F.max(s).alias(f"_cl_{c}"))   # latest non-null in the chunk
        if nxt:
            local[f"_nl_{c}"] = F.last(s, ignorenulls=True).over(w_dn)
            aggs.append(F.min(s).alias(f"_cf_{c}"))   # earliest non-null in the chunk
    out = df.withColumns(local)

    summary = df.groupBy(*keys, chunk).agg(*aggs)
    carry = _carry_chunks(summary, keys, chunk, {f"_cp_{c}": f"_cl_{c}" for c in cols} if prev else {},
                          {f"_cn_{c}": f"_cf_{c}" for c in cols} if nxt else {}, fan)

    out = out.join(carry, on=[*keys, chunk], how="left")
    final = {}
    tmp = []
    for c in cols:
        if prev:
            final[f"_p_{c}"] = F.coalesce(f"_pl_{c}", f"_cp_{c}")
            tmp += [f"_pl_{c}", f"_cp_{c}"]
        if nxt:
            final[f"_n_{c}"] = F.coalesce(f"_nl_{c}", f"_cn_{c}")
            tmp += [f"_nl_{c}", f"_cn_{c}"]
    return out.withColumns(final).drop(*tmp)


def forward_back_fill(df: DataFrame, keys: list[str], order: str, cols: list[str],
                      chunk: str) -> DataFrame:
    """WIN-10: last non-null before, else first non-null after (per column)."""
    if not cols:
        return df
    tmp = carry_prev_next(df, keys, order, cols, chunk)
    tmp = tmp.withColumns({c: F.coalesce(F.col(c), F.col(f"_p_{c}.v"), F.col(f"_n_{c}.v")) for c in cols})
    return tmp.drop(*[f"_p_{c}" for c in cols], *[f"_n_{c}" for c in cols])


def sequence_index(df: DataFrame, keys: list[str], order: list[str], chunk: str,
                   name: str = "seq", fan: int = FAN) -> DataFrame:
    """0-based ordinal of each row within its series: its ordinal in the chunk,
    plus the counts of earlier chunks in its group of chunks and of the earlier
    groups (three-level scan)."""
    local = df.withColumn("_rn", F.row_number().over(
        Window.partitionBy(*keys, chunk).orderBy(*order)) - 1)
    counts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_cnt"))
    counts = counts.withColumn("_sup", F.floor(F.col(chunk) / fan).cast("long"))
    tops = counts.groupBy(*keys, "_sup").agg(F.sum("_cnt").alias("_all"))
    far = tops.select(*keys, "_sup", F.sum("_all").over(Window.partitionBy(*keys).orderBy("_sup").rowsBetween(UNB, -1)).alias("_far"))
    near = F.sum("_cnt").over(Window.partitionBy(*keys, "_sup").orderBy(chunk).rowsBetween(UNB, -1))
    offs = counts.withColumn("_near", near).join(far, [*keys, "_sup"]).select(
        *keys, chunk, (F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))).alias("_off"))
    return (local.join(offs, on=[*keys, chunk], how="left")
                 .withColumn(name, (F.col("_rn") + F.col("_off")).cast("long"))
                 .drop("_rn", "_off"))


def with_halo(df: DataFrame, idx: str, chunk_size: int, halo: int) -> DataFrame:
    """Assign each row to chunk `idx div chunk_size`; the last `halo` rows of
    each chunk are also copied into the next chunk with `_halo = true`, so
    that windows looking back at most `halo` rows can run per chunk.
    Extra data is halo / chunk_size."""
    if halo > chunk_size:
        raise ValueError("halo must not exceed the chunk size")
    c = F.floor(F.col(idx) / chunk_size).cast("long")
    pos = F.col(idx) - c * chunk_size
    # single scan: rows near the chunk end explode into (own, copy)
    copies = F.when(pos >= chunk_size - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = df.select("*", F.explode(copies).alias("_copy"))
    return (out.withColumn("_chunk", c + F.col("_copy"))
               .withColumn("_halo", F.col("_copy") == 1).drop("_copy"))


def lag_columns(df: DataFrame, keys: list[str], idx: str, lags: dict[str, tuple[str, int]],
                chunk_size: int = 10080) -> DataFrame:
    """Add `name = value of col at idx - k` for gap-free integer `idx`.

    One exchange + sort for all lags: rows are chunked with a halo of the
    largest lag, `lag()` runs per (key, chunk) and halo copies are dropped.
    """
    if not lags:
        return df
    halo = max(k for _, k in lags.values())
    size = max(chunk_size, halo)
    h = with_halo(df, idx, size, halo)
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    # gap-free index: the row k positions back is exactly idx - k, or absent
    h = h.withColumns({name: F.when(F.lag(F.col(idx), k).over(w) == F.col(idx) - k,
                                    F.lag(F.col(col), k).over(w))
                       for name, (col, k) in lags.items()})
    return h.where(~F.col("_halo")).drop("_chunk", "_halo")


def chunked_rows_window(df: DataFrame, keys: list[str], idx: str, exprs: dict[str, "callable"],
                        lookback: int, chunk_size: int = 10080) -> DataFrame:
    """Short sliding ROWS frames (at most `lookback` rows back) evaluated per
    chunk with a halo; `exprs[name](window)` builds the column."""
    size = max(chunk_size, lookback)
    h = with_halo(df, idx, size, lookback)
    base = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    h = h.withColumns({name: fn(base) for name, fn in exprs.items()})
    return h.where(~F.col("_halo")).drop("_chunk", "_halo")
