"""Evaluation, calibration and attribution."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.functions.columns import clip, col, logit, sigmoid
from pitloom.operators.history import prior_scan


def positive_rank(ranked: DataFrame, q: list[str], label: str, rank: str = "rank") -> DataFrame:
    """Best rank of a positive per query (null when none was ranked)."""
    return ranked.groupBy(*q).agg(F.min(F.when(F.col(label) == 1, F.col(rank))).alias("best_rank"))


def hit_at_k(best: DataFrame, ks: list[int], by: list[list[str]] = ((),), mrr_cut: int = 20) -> DataFrame:
    """hit@k and truncated MRR of `positive_rank` rows over one or several groupings."""
    r = F.col("best_rank")
    aggs = [F.count("*").alias("queries")]
    aggs += [F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))).alias(f"hit_at_{k}") for k in ks]
    aggs.append(F.avg(F.when(r <= mrr_cut, 1 / r).otherwise(0.0)).alias("mrr"))
    sets = [list(b) for b in by]
    names = sorted({c for b in sets for c in b})
    if not names:
        return best.agg(*aggs)
    return best.groupingSets([[F.col(c) for c in b] for b in sets], *[F.col(c) for c in names]).agg(*aggs)


def lowest(df: DataFrame, metric: str, tie: list[str], n: int = 3) -> DataFrame:
    return df.orderBy(F.col(metric).asc(), *tie).limit(n)


def _cells(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: all a rank statistic needs."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return df.groupBy(*by, F.col(p).alias("_p")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("_pos"), F.sum(F.when(F.col(y) != 1, w).otherwise(0.0)).alias("_neg")
    )


def _auc_of_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve from score cells, ties counted half.

    Cells are ordered inside buckets of the squashed score p / (1 + |p|), of which
    there are at most 4096 whatever the scores are, so a segment with very many
    distinct scores is spread over tasks.
    """
    keys = by or ["_all"]
    src = cells if by else cells.withColumn("_all", F.lit(0))
    seen = prior_scan(src, keys, F.floor(F.col("_p") / (1 + F.abs("_p")) * 2048), ["_p"], {"_below": ("sum", F.col("_neg"))})
    won = F.sum(F.col("_pos") * (F.coalesce("_below", F.lit(0.0)) + F.col("_neg") / 2))
    return seen.groupBy(*keys).agg(
        F.try_divide(won, F.sum("_pos") * F.sum("_neg")).alias("auc"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg")
    ).select(*by, "auc", F.col("n_pos"), F.col("n_neg"))


def auc(df: DataFrame, y: str, p: str, by: list[str] = (), weight: str | None = None) -> DataFrame:
    return _auc_of_cells(_cells(df, y, p, list(by), weight), list(by))


def loss_columns(y: str, p: str, eps: float = 1e-15) -> dict[str, Column]:
    q = clip(p, eps, 1 - eps)
    yy = F.col(y).cast("double")
    return {
        "log_loss": F.avg(-(yy * F.ln(q) + (1 - yy) * F.ln(1 - q))),
        "brier": F.avg((F.col(p) - yy) * (F.col(p) - yy)),
        "accuracy": F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")),
    }


def losses(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in loss_columns(y, p).items()])


def segment_metrics(df: DataFrame, segment: str, y: str, p: str, min_n: int = 10) -> DataFrame:
    """AUC and losses per segment; small and single-class segments are left out."""
    ok = losses(df, y, p, [segment]).join(auc(df, y, p, [segment]), segment)
    return ok.filter((F.col("n") >= min_n) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)).drop("n_pos", "n_neg")


#: The largest mean that is drawn at once; Poisson numbers of a larger mean are sums of several.
_MEAN = 16
#: The step and the two multipliers of splitmix64.
_STEP, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x):
    """Spreads 64-bit numbers over the whole range."""
    import numpy as np

    u = np.uint64
    x = (x ^ (x >> u(30))) * u(_MIX[0])
    x = (x ^ (x >> u(27))) * u(_MIX[1])
    return x ^ (x >> u(31))


def _thresholds():
    """For each mean from 0 to _MEAN the chances that a Poisson number is at most 0, 1, 2, ..."""
    import numpy as np

    term = np.exp(-np.arange(_MEAN + 1, dtype=float))
    rows = [term]
    for k in range(1, 90):
        term = term * np.arange(_MEAN + 1) / k
        rows.append(term)
    return np.cumsum(np.array(rows), axis=0).T


def poisson_weights(means, starts, n: int):
    """(rows, n) Poisson numbers by inversion; `means` up to _MEAN. A row's n chances follow from its start, so they are the same in any partitioning and engine."""
    import numpy as np

    key = starts[:, None] + np.arange(n, dtype=np.uint64)[None, :] * np.uint64(_STEP)
    chance = (_mixed(key) >> np.uint64(12)).astype(np.float64) * 2.0**-52
    table, out = _thresholds(), np.zeros((len(means), n))
    for m in np.unique(means).tolist():
        same = means == m
        out[same] = np.searchsorted(table[m], chance[same], side="right")
    return out


def bootstrap_ci(df: DataFrame, y: str, p: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the AUC over Poisson resamples: lower, upper, mean, resamples.

    Rows with the same label and the same score are interchangeable, so a resample draws one Poisson(count) for each of
    these cells; MD5 of seed, label, score (times 2^40, floored) and part starts its draws. Cells are dealt by ranges of
    the score and summed in blocks of a matrix (cells x resamples): cumulative sums give the pairs won inside a
    range, and what ranges win against each other is added from one row per range.
    """
    import numpy as np
    import pyarrow as pa

    cells = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    cells = cells.groupBy(F.col(p).cast("double").alias("p")).agg(*(F.count_if(F.col(y) == label).alias(name) for label, name in ((1, "pos"), (0, "neg"))))
    cells = cells.repartitionByRange("p").sortWithinPartitions("p")
    place = F.floor(F.col("p") * (1 << 40)).cast("long").cast("string")
    cells = cells.select("p", "pos", "neg", *(F.concat_ws(":", F.lit(str(seed)), F.lit(str(label)), place).alias(f"key{label}") for label in (1, 0)))

    def drawn(counts, keys):
        """The numbers of one label in a block: the parts of each cell, summed."""
        import hashlib

        parts = np.maximum(-(-counts // _MEAN), 1)
        cell = np.repeat(np.arange(len(counts)), parts)
        part = np.arange(len(cell)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.array([int(hashlib.md5(f"{keys[c]}:{k}".encode()).hexdigest()[:16], 16) for c, k in zip(cell.tolist(), part.tolist())], dtype=np.uint64)
        out, first = np.zeros((len(counts), n)), np.cumsum(parts) - parts
        for at in range(0, len(counts), 64):  # a few cells of a large count are a large matrix already
            rows = slice(first[at], first[at] + parts[at : at + 64].sum())
            w = poisson_weights(np.minimum(counts[cell[rows]] - part[rows] * _MEAN, _MEAN), starts[rows], n)
            out[at : at + 64] = np.add.reduceat(w, first[at : at + 64] - first[at], axis=0)
        return out

    def draw(batches):
        won, pos, neg, low = np.zeros(n), np.zeros(n), np.zeros(n), None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                low = part.column("p")[0].as_py() if low is None else low
                up = drawn(part.column("pos").to_numpy(), part.column("key1").to_pylist())
                down = drawn(part.column("neg").to_numpy(), part.column("key0").to_pylist())
                below = np.cumsum(down, axis=0) - down
                won += (up * (neg + below + down / 2)).sum(axis=0)
                pos, neg = pos + up.sum(axis=0), neg + down.sum(axis=0)
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([won]), pa.array([pos]), pa.array([neg])], names=["low", "won", "pos", "neg"])

    def combine(table: pa.Table) -> pa.Table:
        won, pos, neg = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in table.sort_by("low").to_pylist():
            won += np.array(r["won"]) + np.array(r["pos"]) * neg
            pos, neg = pos + r["pos"], neg + r["neg"]
        with np.errstate(invalid="ignore", divide="ignore"):
            auc_n = won / (pos * neg)
        auc_n = auc_n[np.isfinite(auc_n)]
        some = len(auc_n) > 0
        ends = np.quantile(auc_n, [0.025, 0.975]).tolist() if some else [None, None]
        return pa.table({"lower": pa.array(ends[:1], pa.float64()), "upper": pa.array(ends[1:], pa.float64()), "mean": pa.array([float(auc_n.mean()) if some else None], pa.float64()), "resamples": pa.array([len(auc_n)])})

    per = cells.mapInArrow(draw, "low double, won array<double>, pos array<double>, neg array<double>")
    return per.groupBy(F.lit(0).alias("all")).applyInArrow(combine, "lower double, upper double, mean double, resamples long")  # a row for each range


def fold_summary(metrics: DataFrame, metric: str, fold: str, baseline: float, band: float = 0.005, by: list[str] = ()) -> DataFrame:
    """Mean and population deviation over folds, verdict against a baseline, late minus early half."""
    half = F.floor((F.max(fold) + F.min(fold)) / 2)
    agg = metrics.groupBy(*by).agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), half.alias("_h"), F.collect_list(F.struct(fold, metric)).alias("_l")
    )

    def mean(test):
        part = F.filter("_l", lambda e: test(e[fold]))
        return F.try_divide(F.aggregate(part, F.lit(0.0), lambda s, e: s + e[metric]), F.size(part))

    delta = F.col("mean") - baseline
    return agg.select(
        *by,
        "mean",
        "std",
        delta.alias("delta"),
        F.when(delta > band, "better").when(delta < -band, "worse").otherwise("same").alias("verdict"),
        (mean(lambda f: f > F.col("_h")) - mean(lambda f: f <= F.col("_h"))).alias("late_minus_early"),
    )


def scaled_probability(p, t) -> Column:
    return sigmoid(logit(p) / t)


def temperature(df: DataFrame, y: str, p: str, lo: float = 0.5, hi: float = 3.0, steps: int = 51) -> DataFrame:
    """Negative log likelihood per temperature of a grid in one pass; the smallest is flagged."""
    grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
    yy = F.col(y).cast("double")

    def nll(t):
        q = clip(scaled_probability(p, t), 1e-12, 1 - 1e-12)
        return F.avg(-(yy * F.ln(q) + (1 - yy) * F.ln(1 - q)))

    one = df.agg(*[nll(t).alias(f"_{i}") for i, t in enumerate(grid)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"_{i}").alias("nll")) for i, t in enumerate(grid)])))
    best = long.agg(F.min_by("t", F.struct("nll", "t")).alias("t")).scalar()
    return long.withColumn("best", F.col("t") == best)


def ensemble_prob(preds: DataFrame, row: list[str], fold: str, p: str) -> DataFrame:
    """Mean per fold, mean of the folds, deviation over folds and the verdict band (0.10)."""
    per = preds.groupBy(*row, fold).agg(F.avg(p).alias("_m"))
    out = per.groupBy(*row).agg(F.avg("_m").alias("prob"), F.stddev_pop("_m").alias("fold_std"))
    gap = 2 * F.col("prob") - 1
    return out.withColumn(
        "verdict", F.when(F.abs(gap) < 0.10, "even").when(gap > 0, "blue").otherwise("red")
    )


def draft_delta(df: DataFrame, pre: str, post: str) -> DataFrame:
    d = F.col(post) - F.col(pre)
    a = F.abs(d)
    return df.withColumns(
        {
            "delta": d,
            "direction": F.when(d > 0.005, "blue").when(d < -0.005, "red").otherwise("even"),
            "impact": F.when(a >= 0.10, "huge").when(a >= 0.05, "significant").when(a >= 0.02, "moderate").otherwise("slight"),
        }
    )


def importance_share(imp: DataFrame, keywords, feature="feature", value="importance") -> DataFrame:
    """Share of draft and hard features in the total importance."""
    is_draft = F.lit(False)
    for k in keywords:
        is_draft = is_draft | F.contains(F.col(feature), F.lit(k))
    total = imp.agg(F.sum(value).alias("t")).scalar()
    return imp.groupBy(F.when(is_draft, "draft").otherwise("hard").alias("family")).agg(
        F.count("*").alias("features"), (F.sum(value) / total).alias("share")
    )


def waterfall(contrib: DataFrame, row: str, k: int = 10, target: DataFrame | None = None) -> DataFrame:
    """Top positive, then top negative contributions with bar length and step in probability.

    contrib: row id, feature, contribution, base_value. `target` (row id,
    target_prob) recalibrates the base so that base + all contributions meets
    the full ensemble's probability. A row holds one entry per feature.
    """
    c = F.col("contribution")
    rows = contrib
    if target is not None:
        tot = contrib.groupBy(row).agg((F.first("base_value") + F.sum("contribution")).alias("_z"))
        shift = tot.join(target, row).select(row, (logit("target_prob") - F.col("_z")).alias("_d"))
        rows = contrib.join(shift, row).withColumn("base_value", F.col("base_value") + F.col("_d")).drop("_d")
    sign = F.when(c > 1e-6, 1).when(c < -1e-6, -1)
    w = W.partitionBy(row, "_sign").orderBy(F.abs(c).desc(), "feature")
    top = rows.withColumn("_sign", sign).filter(F.col("_sign").isNotNull())
    top = top.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    flow = W.partitionBy(row).orderBy(F.col("_sign").desc(), "_r")
    after = F.col("base_value") + F.sum("contribution").over(flow.rowsBetween(W.unboundedPreceding, 0))
    largest = F.max(F.abs(c)).over(W.partitionBy(row))
    return top.select(
        row,
        F.row_number().over(flow).alias("position"),
        "feature",
        "contribution",
        F.when(F.col("_sign") == 1, "positive").otherwise("negative").alias("direction"),
        (F.abs(c) / largest * 100).alias("bar_pct"),
        ((sigmoid(after) - sigmoid(after - c)) * 100).alias("prob_delta"),
    )


def lane_verdict(rate) -> Column:
    r = col(rate)
    return F.when(r.isNull(), "none").when(r > 0.52, "blue").when(r < 0.48, "red").otherwise("even")


def lane_tally(lanes: DataFrame, key: str, side: str = "verdict") -> DataFrame:
    agg = lanes.groupBy(key).agg(F.count_if(F.col(side) == "blue").alias("blue_lanes"), F.count_if(F.col(side) == "red").alias("red_lanes"))
    b, r = F.col("blue_lanes"), F.col("red_lanes")
    return agg.withColumn("advantage", F.when(b > r, "blue").when(r > b, "red").otherwise("even"))


def lineup_pairs(df: DataFrame, key: list[str], champions: list[str]) -> DataFrame:
    """The ten unordered pairs of a five-slot lineup, unfolded in the row (no self join)."""
    pairs = [
        F.struct(F.col(champions[i]).alias("a"), F.col(champions[j]).alias("b"))
        for i in range(len(champions))
        for j in range(i + 1, len(champions))
    ]
    return df.select(*key, F.inline(F.array(*pairs)))


def lane_power(lineups: DataFrame, tags: DataFrame, cols: list[str], key: list[str], default: dict) -> DataFrame:
    """Sum of the tags per lane and side (missing champion: defaults)."""
    j = lineups.join(tags, "champion", "left")
    total = None
    for c in cols:
        x = F.coalesce(F.col(c), F.lit(default[c]))
        total = x if total is None else total + x
    return j.groupBy(*key).agg(F.sum(total).alias("power"))


def explain(features: DataFrame, dictionary: DataFrame, feature: str = "feature") -> DataFrame:
    """Description per feature: exact name first, else the longest dictionary prefix.

    dictionary: name, text. Prefixes of each distinct feature are listed and
    joined by equality.
    """
    names = features.select(feature).distinct()
    cand = names.select(feature, F.explode(F.sequence(F.lit(1), F.length(feature))).alias("_l"))
    cand = cand.withColumn("_p", F.expr(f"substring({feature}, 1, _l)"))
    best = cand.join(dictionary, F.col("_p") == F.col("name")).groupBy(feature).agg(F.max_by("text", "_l").alias("text"))
    return features.join(best, feature, "left")


def score(df: DataFrame, model, cols: list[str], out: str = "p") -> DataFrame:
    """Apply a picklable model (predict over a float matrix, one or several for an ensemble mean).

    The model travels inside the function, which Spark turns into a broadcast
    once it is large; batches are Arrow.
    """
    import pandas as pd

    models = model if isinstance(model, (list, tuple)) else [model]

    def run(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float32")
            p = sum(m.predict(x) for m in models) / len(models)
            yield pdf.assign(**{out: pd.Series(p, index=pdf.index, dtype="float64")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` double")


def fit_bagged(df: DataFrame, cols: list[str], label: str, weight: str | None = None, seeds: list[int] = (42,), kind: str = "gbt", share: float = 1.0, **params):
    """One Spark ML classifier per seed; returns the fitted models. With `share` below 1 each sees that part of the
    rows, chosen by a hash of the row and the seed, so in any partitioning the same."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)
    models = []
    for s in seeds:
        if kind == "gbt":
            est = GBTClassifier(labelCol=label, featuresCol="features", seed=s, subsamplingRate=0.8, **params)
        else:
            est = LogisticRegression(labelCol=label, featuresCol="features", **params)
        if weight:
            est = est.setWeightCol(weight)
        part = F.pmod(F.xxhash64(*cols, label, F.lit(s)), F.lit(1_000_000)) < int(share * 1_000_000)
        models.append(est.fit(data.filter(part) if share < 1 else data))
    return models


def predict_bagged(df: DataFrame, models, cols: list[str], out: str = "p") -> DataFrame:
    """Mean probability of class 1 over the models."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)
    total = F.lit(0.0)
    for i, m in enumerate(models):
        data = m.transform(data).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        total = total + F.col(f"_p{i}")
    return data.withColumn(out, total / len(models)).drop("features", *[f"_p{i}" for i in range(len(models))])
