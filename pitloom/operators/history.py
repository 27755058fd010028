"""Point-in-time aggregation over entity histories.

Nothing here windows over a whole entity. A history is cut into (entity, time
bucket) cells: inside a cell the rows are ordered and scanned, between the
cells only one pre-aggregated row per cell is scanned. An entity that owns a
third of all rows is thus spread over as many tasks as it has buckets, and the
per-entity scan sees at most one row per bucket.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.functions.columns import DAY_US, col, micros

_COMBINE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.when(b.isNull() | (a > b), a).otherwise(b),
    "min": lambda a, b: F.when(b.isNull() | (a < b), a).otherwise(b),
}
_TOTAL = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_LOCAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def prior_scan(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list,
    aggs: dict[str, tuple[str, Column]],
    peers: str = "rows",
    inclusive: bool = False,
    null_keys: bool = True,
) -> DataFrame:
    """Add, to every row, aggregates over the rows of its key that come before it.

    `bucket` must grow with `order`. `peers="rows"`: every earlier row counts;
    `peers="ties"`: rows equal in the (single, integer) order column do not see
    each other. `inclusive` also counts the row itself (and its peers).
    `null_keys=False` promises that no key is null; then the rows are shuffled once only.
    `aggs` maps an output name to ("sum" | "count" | "max" | "min", column).
    """
    src = df.withColumn("_b", bucket)
    cell = W.partitionBy(*keys, "_b").orderBy(*order)
    edge = 0 if inclusive else -1
    if peers == "ties":
        inside = cell.rangeBetween(W.unboundedPreceding, edge)
    else:
        inside = cell.rowsBetween(W.unboundedPreceding, edge)

    totals = src.groupBy(*keys, "_b").agg(*[_LOCAL[fn](e).alias(f"_t_{n}") for n, (fn, e) in aggs.items()])
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_kb"),
        *[_TOTAL[fn](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (fn, _) in aggs.items()],
    )
    local = src.select("*", *[_LOCAL[fn](e).over(inside).alias(f"_l_{n}") for n, (fn, e) in aggs.items()])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) if null_keys else F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    joined = local.join(carry, on, "left")
    out = [_COMBINE[fn](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (fn, _) in aggs.items()]
    return joined.select(*df.columns, *out)


class Measure(NamedTuple):
    """One trailing sum (or, under sequence isolation, minimum) of a column."""

    expr: Column
    half_life: float | None = None
    window: float | None = None
    fn: str = "sum"


#: Weights below exp(-FADED) count as nothing; twice that is the range of a double.
FADED = 600.0
_UNLIMITED_BLOCK = FADED / 2


def decayed_carry(total: Column, keys: list[str], lam: float) -> Column:
    """Sum over all earlier cells of a key, each weighted with exp(-lam * buckets), for any date and half life.

    Buckets fall into blocks no longer than a double can span, and weights are relative to a block's start. A row sums its
    own block and takes the two before as a whole.
    """
    length = max(1, int(_UNLIMITED_BLOCK / lam))
    block = F.floor(F.col("_b") / length)
    here = F.exp((F.col("_b") - block * length) * lam)
    own = total * here
    inside = F.sum(own).over(W.partitionBy(*keys, block).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    by_block = W.partitionBy(*keys).orderBy(block.cast("long"))
    parts = [inside] + [F.sum(own).over(by_block.rangeBetween(-j, -j)) * math.exp(-lam * length * j) for j in (1, 2)]
    some = F.coalesce(*parts)
    whole = parts[0]
    for x in parts[1:]:
        whole = _COMBINE["sum"](whole, x)
    return F.when(some.isNotNull(), whole / here)


def _limited_carry(cells: DataFrame, keys: list[str], limited: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Add _c_{name}, the sum (or minimum) of _t_{name} over the `back` buckets before a cell, to the one row of each key and bucket.

    limited: name -> (function, decay a bucket, back). Buckets fall into blocks of `back`, so a window is the end of one block
    and the start of the next: a running sum of the cell's own block, and one from the other side over the block before,
    whose cells come once more, shifted by `back`. Each row is thus added once on either side, however long the window
    is. Weights are relative to the block's start; beyond the range of a double they count as nothing.
    """
    lengths = {n: min(back, max(1, int(FADED / lam))) if lam else back for n, (_, lam, back) in limited.items()}
    rows = cells.withColumn("_e", F.explode(F.array(*[F.lit(e) for e in (0, *sorted(set(lengths.values())))])))
    rows = rows.withColumn("_b", F.col("_b") + F.col("_e"))
    agg = {"sum": F.sum, "min": F.min}
    made = []
    for n, (fn, lam, _) in limited.items():
        length = lengths[n]
        block = F.floor(F.col("_b") / length)
        since = F.col("_b") - block * length
        here, shifted = F.exp(since * lam), F.exp((since - length) * lam)
        own, left = (F.col(f"_t_{n}") * w if lam else F.col(f"_t_{n}") for w in (here, shifted))
        w = W.partitionBy(*keys, block)
        up = agg[fn](F.when(F.col("_e") == 0, own)).over(w.orderBy("_b").rangeBetween(W.unboundedPreceding, -1))
        down = agg[fn](F.when(F.col("_e") == length, left)).over(w.orderBy(F.col("_b").desc()).rangeBetween(W.unboundedPreceding, 0))
        both = _COMBINE[fn](up, down)
        made.append((both / here if lam else both).alias(f"_c_{n}"))
    return rows.select(*cells.columns, "_e", *made).filter("_e = 0").drop("_e")


def _measures(measures, window_days, half_life) -> dict[str, Measure]:
    out = {}
    for n, v in measures.items():
        if isinstance(v, Measure):
            out[n] = v
        elif isinstance(v, tuple):
            out[n] = Measure(col(v[0]), half_life if v[1] else None, window_days)
        else:
            out[n] = Measure(col(v), half_life, window_days)
    return out


def trailing_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    measures: dict,
    window_days: float | None = 90,
    half_life: float | None = None,
    isolation: str = "strict_time",
    seq: list | None = None,
    bucket_us: int = DAY_US,
    lower: str = "inclusive",
    run: int | None = None,
) -> DataFrame:
    """Sums over the earlier rows of the same key inside trailing windows.

    measures: name -> Measure, or a column (with the call's window and half
    life), or (column, decayed?). A null value adds nothing, so rows that are
    only looked up carry null measures. A decayed measure is weighted with
    2^(-age in days / half_life). A window of None reaches back without limit.
    Measures with different windows share the same two shuffles.

    isolation="strict_time": rows with t' < t and t' >= t - window; equal
    timestamps never see each other; ages are fractional days.
    isolation="sequence": rows earlier in `seq`; time is cut to days, so an
    earlier row of the same day has age 0 and the window is [day - W, day]
    (`lower="exclusive"`: day - W itself is out). A day of a key is ordered in one
    task, unless `run` is given: then it is cut into runs of that many numbers of the
    last (whole number) column of `seq`, and only the runs' sums are scanned together.

    A sum over no rows is null.
    """
    m = _measures(measures, window_days, half_life)
    seq_mode = isolation == "sequence"
    if seq_mode:
        bucket_us = DAY_US
    elif any(x.fn != "sum" for x in m.values()):
        raise ValueError("minimum measures need sequence isolation")
    per_day = DAY_US / bucket_us

    def rate(x: Measure) -> float:
        return math.log(2) / x.half_life if x.half_life else 0.0

    def buckets_back(x: Measure) -> int | None:
        if x.window is None:
            return None
        n = round(x.window * per_day)
        if abs(n * bucket_us - x.window * DAY_US) > 1:
            raise ValueError("the window must be a whole number of buckets")
        return n

    nb = {n: buckets_back(x) for n, x in m.items()}
    us = micros(ts)
    src = df.withColumn("_b", F.floor(us / F.lit(bucket_us)).cast("long"))
    src = src.withColumn("_t", us - F.col("_b") * bucket_us)
    age = F.col("_t") / F.lit(float(DAY_US))

    def value(x: Measure) -> Column:
        if x.fn != "sum":
            return x.expr
        v = x.expr.cast("double")
        return v if seq_mode or not x.half_life else v * F.exp(age * rate(x))

    agg = {"sum": F.sum, "min": F.min}
    whole = src
    if seq_mode:
        src = src.select(*df.columns, "_b", "_t", *[value(x).alias(f"_x_{n}") for n, x in m.items()])
    else:
        # rows of one time have one answer, so the scans see one narrow row per (key, time)
        src = src.groupBy(*keys, "_b", "_t").agg(*[F.sum(value(x)).alias(f"_x_{n}") for n, x in m.items()])

    # between the cells: one row per (key, bucket)
    totals = src.groupBy(*keys, "_b").agg(*[agg[x.fn](f"_x_{n}").alias(f"_t_{n}") for n, x in m.items()])
    earlier = W.partitionBy(*keys).orderBy("_b").rangeBetween(W.unboundedPreceding, -1)
    carry, limited = {}, {}
    for n, x in m.items():
        back, lam = nb[n], rate(x) / per_day if x.fn == "sum" else 0.0
        if back is not None and (not seq_mode or lower == "exclusive"):
            back -= 1  # the oldest bucket is only partly inside, or out
        if back is None:
            carry[n] = decayed_carry(F.col(f"_t_{n}"), keys, lam) if lam else agg[x.fn](f"_t_{n}").over(earlier)
        elif back < 1:
            carry[n] = F.lit(None).cast(src.schema[f"_x_{n}"].dataType)
        else:
            limited[n] = (x.fn, lam, back)
    kept = [f"_t_{n}" for n in limited]
    hist = totals.select(*keys, "_b", *kept, *[c.alias(f"_c_{n}") for n, c in carry.items()])
    if limited:
        hist = _limited_carry(hist, keys, limited).drop(*kept)

    # inside the cells
    cell = W.partitionBy(*keys, "_b")
    edges = sorted({x for x in nb.values() if x is not None})
    if seq_mode:
        if run:
            place = F.struct(*[F.col(c) for c in seq[:-1]], F.floor(F.col(seq[-1]) / run).alias("_run"))
            scanned = src.withColumnRenamed("_b", "_day")
            local = prior_scan(scanned, [*keys, "_day"], place, seq, {f"_l_{n}": (x.fn, F.col(f"_x_{n}")) for n, x in m.items()}).withColumnRenamed("_day", "_b")
        else:
            inside = cell.orderBy(*(seq or ["_t"])).rowsBetween(W.unboundedPreceding, -1)
            local = src.select(
                *df.columns, "_b", "_t", *[agg[x.fn](f"_x_{n}").over(inside).alias(f"_l_{n}") for n, x in m.items()]
            )
    else:
        # a row comes once as itself (_e = 0) and once per window length as the
        # lower edge, shifted to the bucket where it is about to leave
        rows = src.withColumn("_e", F.explode(F.array(*[F.lit(e) for e in (0, *edges)])))
        rows = rows.withColumn("_b", F.col("_b") + F.col("_e"))
        up = cell.orderBy("_t").rangeBetween(W.unboundedPreceding, -1)
        down = cell.orderBy(F.col("_t").desc()).rangeBetween(W.unboundedPreceding, 0)

        def both(n):
            live = F.sum(F.when(F.col("_e") == 0, F.col(f"_x_{n}"))).over(up)
            if nb[n] is None:
                return live
            leaving = F.sum(F.when(F.col("_e") == nb[n], F.col(f"_x_{n}"))).over(down)
            leaving = leaving * math.exp(-rate(m[n]) / per_day * nb[n])
            return F.coalesce(live + leaving, live, leaving)

        local = rows.select(*keys, "_b", "_t", "_e", *[both(n).alias(f"_l_{n}") for n in m]).filter("_e = 0")

    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys] + [F.col("l._b") == F.col("h._b")]
    joined = local.alias("l").join(hist.alias("h"), cond, "left")
    out = []
    for n, x in m.items():
        a, b = F.col(f"l._l_{n}"), F.col(f"h._c_{n}")
        s = _COMBINE[x.fn](a, b)
        if x.half_life and not seq_mode:
            s = s * F.exp(F.col("l._t") / F.lit(float(DAY_US)) * (-rate(x)))
        out.append(s.alias(n))
    if seq_mode:
        return joined.select(*[F.col(f"l.{c}") for c in df.columns], *out)
    at = joined.select(*[F.col(f"l.{k}") for k in keys], F.col("l._b"), F.col("l._t"), *[x.alias(f"_s_{n}") for n, x in zip(m, out)])
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("r._b").eqNullSafe(F.col("p._b")), F.col("r._t").eqNullSafe(F.col("p._t"))]
    found = whole.select(*df.columns, "_b", "_t").alias("r").join(at.alias("p"), same, "left")
    return found.select(*[F.col(f"r.{c}") for c in df.columns], *[F.col(f"p._s_{n}").alias(n) for n in m])


def decayed_mean(df, keys, ts, x, half_life, window, isolation="strict_time", seq=None, skip_null=True, name="mean", run=None):
    """Decayed trailing mean of `x`, its weight and the number of rows behind it."""
    x = col(x)
    live = x.isNotNull() if skip_null else F.lit(True)
    one = F.when(live, F.lit(1.0))
    out = trailing_sums(
        df,
        keys,
        ts,
        {"_wx": x, "_w": one, "_n": (one, False)},
        window_days=window,
        half_life=half_life,
        isolation=isolation,
        seq=seq,
        run=run,
    )
    return out.select(
        *df.columns,
        F.try_divide("_wx", "_w").alias(name),
        F.col("_w").alias(f"{name}_weight"),
        F.coalesce(F.col("_n"), F.lit(0.0)).cast("long").alias(f"{name}_n"),
    )


def last_n(df, keys, bucket, order, value, n, out="last", time=None, strict=True) -> DataFrame:
    """Array of the n rows before each row (oldest first), as structs (t, v).

    Per bucket only the newest n rows are kept and carried over the next
    n buckets, so no task sees an entity's history. With `strict`, rows that
    share `time` do not see each other.
    """
    t = col(time if time is not None else order[0])
    src = df.withColumn("_b", bucket).withColumn("_e", F.struct(t.alias("t"), col(value).alias("v")))
    cell = W.partitionBy(*keys, "_b").orderBy(*order)
    newest = W.partitionBy(*keys, "_b").orderBy(*[col(o).desc() for o in order])
    tail = (
        src.withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= n)
        .groupBy(*keys, "_b")
        .agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_r", "_e")))), lambda s: s["_e"]).alias("_tail"))
    )
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(-n, -1)
    carry = tail.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_kb"),
        F.flatten(F.collect_list("_tail").over(before)).alias("_carry"),
    )
    local = src.withColumn("_loc", F.collect_list("_e").over(cell.rowsBetween(-n, -1)))
    if strict:
        peers = W.partitionBy(*keys, "_b", "_pt").orderBy(*order)
        local = local.withColumn("_pt", t).withColumn("_loc", F.first("_loc").over(peers))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    joined = local.join(carry, on, "left")
    whole = F.concat(F.coalesce(F.col("_carry"), F.array().cast(tail.schema["_tail"].dataType)), F.col("_loc"))
    size = F.size("_all_n")
    return joined.withColumn("_all_n", whole).select(
        *df.columns,
        F.when(size > n, F.slice("_all_n", size - n + 1, n)).otherwise(F.col("_all_n")).alias(out),
    )


def last_n_rate(df, keys, ts, order, x, n, window_days, bucket=None, out="rate", strict=True):
    """Mean of the newest n values inside the trailing window (fewer if fewer exist).

    `n` may be a list of lengths, answered from one scan as {out}_{n}.
    """
    lengths = [n] if isinstance(n, int) else sorted(n)
    names = [out] if isinstance(n, int) else [f"{out}_{k}" for k in lengths]
    t = micros(ts)
    b = bucket if bucket is not None else F.floor(t / F.lit(DAY_US))
    src = df.withColumn("_us", t)
    full = last_n(src, keys, b, order, x, lengths[-1], "_ln", time="_us", strict=strict)
    inside = F.filter("_ln", lambda e: e["t"] >= F.col("_us") - int(window_days * DAY_US))
    full = full.withColumn("_in", inside)

    def mean(k):
        newest = F.slice("_in", F.greatest(F.size("_in") - k + 1, F.lit(1)), k)
        total = F.aggregate(newest, F.lit(0.0), lambda a, e: a + e["v"].cast("double"))
        return F.when(F.size(newest) > 0, F.try_divide(total, F.size(newest)))

    return full.select(*df.columns, *[mean(k).alias(name) for k, name in zip(lengths, names)])


def streak(df, keys, bucket, order, result, out="streak"):
    """Signed run length of the newest result before each row, over all history.

    The run is the distance between the row's index and the newest row with the
    other result. Inside a cell that needs running maxima of local indexes;
    between the cells the offset of the cell and the newest index seen so far.
    """
    src = df.withColumn("_b", bucket).withColumn("_r", col(result))
    cell = W.partitionBy(*keys, "_b").orderBy(*order)
    prior = cell.rowsBetween(W.unboundedPreceding, -1)
    local = src.withColumn("_i", F.row_number().over(cell) - 1)
    win, loss = F.when(F.col("_r") == 1, F.col("_i")), F.when(F.col("_r") != 1, F.col("_i"))
    local = local.withColumns({"_lw": F.max(win).over(prior), "_ll": F.max(loss).over(prior)})
    cells = local.groupBy(*keys, "_b").agg(
        F.count("*").alias("_n"), F.max(win).alias("_w"), F.max(loss).alias("_l")
    )
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carry = cells.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_b").alias("_kb"),
        "_off",
        F.max(F.col("_off") + F.col("_w")).over(before).alias("_cw"),
        F.max(F.col("_off") + F.col("_l")).over(before).alias("_cl"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b") == F.col("_kb")]
    seen = local.join(carry, on, "left")
    lw = F.coalesce(F.col("_off") + F.col("_lw"), F.col("_cw"), F.lit(-1))
    ll = F.coalesce(F.col("_off") + F.col("_ll"), F.col("_cl"), F.lit(-1))
    first = F.col("_off") + F.col("_i") == 0
    return seen.select(*df.columns, F.when(first, F.lit(0)).otherwise(lw - ll).cast("long").alias(out))


def conditional_rate(num, den, min_n):
    """num / den where at least `min_n` rows qualified, else null."""
    return F.when(col(den) >= min_n, F.try_divide(col(num), col(den)))


def sequence_decay(df, keys, seq, x, half_life=500.0):
    """Mean of x weighted with 2^(-(newest seq - seq) / half_life), per key.

    A common factor of the weights cancels, so they are relative to the end of a block of a few hundred half lives, and the
    blocks' sums to the end of the key's newest block: the newest rows weigh something however far other keys have come.
    """
    length = float(half_life) * FADED / 2
    block = F.floor(F.col(seq) / F.lit(length)).alias("_b")
    w = F.pow(F.lit(2.0), (F.col(seq) - (F.floor(F.col(seq) / F.lit(length)) + 1) * F.lit(length)) / F.lit(float(half_life)))
    cells = df.groupBy(*keys, block).agg(F.sum(col(x) * w).alias("_x"), F.sum(w).alias("_w"), F.count("*").alias("_n"))
    fold = F.col("_b") - F.max("_b").over(W.partitionBy(*keys))
    far = F.pow(F.lit(2.0), fold * F.lit(length / float(half_life)))
    cells = cells.select(*keys, (F.col("_x") * far).alias("_x"), (F.col("_w") * far).alias("_w"), "_n")
    return cells.groupBy(*keys).agg(F.try_divide(F.sum("_x"), F.sum("_w")).alias("value"), F.sum("_n").alias("n"))
