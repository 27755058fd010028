"""Time splits and training-frame preparation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.functions.columns import col, decay_weight
from pitloom.operators.history import prior_scan


def oot_folds(latest, n: int = 5, train_m: int = 12, test_m: int = 2, gap_m: int = 0) -> Column:
    """Rolling out-of-time folds, oldest first, as an array of structs of dates.

    `latest` is a date, a text or a column; months shrink to the last valid day.
    """
    end = F.lit(latest).cast("date") if isinstance(latest, (str, date)) else latest.cast("date")
    folds = []
    for f, i in enumerate(range(n - 1, -1, -1)):
        test_end = F.add_months(end, -i * (test_m + gap_m))
        test_start = F.date_add(F.add_months(test_end, -test_m), 1)
        train_end = F.date_sub(test_start, 1)
        train_start = F.date_add(F.add_months(train_end, -train_m), 1)
        folds.append(
            F.struct(
                F.lit(f).alias("fold"),
                train_start.alias("train_start"),
                train_end.alias("train_end"),
                test_start.alias("test_start"),
                test_end.alias("test_end"),
            )
        )
    return F.array(*folds)


def assign_folds(df: DataFrame, date_col: str, **kw) -> DataFrame:
    """Rows once per fold they belong to, with fold and split ('train' or 'test')."""
    end = df.agg(F.max(F.to_date(date_col)).alias("d")).scalar()
    d = F.to_date(F.col(date_col))
    src = df.withColumn("_folds", oot_folds(end, **kw))
    tagged = F.transform(
        F.col("_folds"),
        lambda f: F.struct(
            f["fold"].alias("fold"),
            F.when((d >= f["train_start"]) & (d <= f["train_end"]), "train")
            .when((d >= f["test_start"]) & (d <= f["test_end"]), "test")
            .alias("split"),
        ),
    )
    hit = src.withColumn("_f", F.explode(F.filter(tagged, lambda t: t["split"].isNotNull())))
    return hit.select(*df.columns, "_f.fold", "_f.split")


def time_split(df: DataFrame, index: str, val_ratio: float = 0.15) -> DataFrame:
    """Chronological split on a dense 0-based index: the last floor(n * ratio) rows validate."""
    n = df.agg(F.count("*").alias("n")).scalar()
    cut = n - F.floor(n * val_ratio)
    return df.withColumn("split", F.when(F.col(index) < cut, "train").otherwise("val"))


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold number per group from the first 60 bits of an MD5, so groups stay whole without any shuffle."""
    return df.withColumn("fold", F.pmod(_place(F.col(group).cast("string")), F.lit(k)).cast("int"))


def _place(key):
    """A number below 2 ** 60 that any engine with MD5 finds again."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sessionise(df: DataFrame, keys: list[str], bucket, order: list[str], step: str, out: str = "match_no") -> DataFrame:
    """New number whenever the step does not grow against the row before it (per key, from 0)."""
    before = prior_scan(
        df, keys, bucket, order, {"_p": ("max", F.struct(*order, F.col(step).alias("_step")))}
    )
    flag = F.when(F.col("_p").isNotNull() & (F.col(step) <= F.col("_p._step")), 1).otherwise(0)
    flagged = before.withColumn("_new", flag)
    counted = prior_scan(flagged, keys, bucket, order, {"_c": ("sum", F.col("_new"))}, inclusive=True)
    return counted.select(*df.columns, F.col("_c").cast("long").alias(out))


def mirror(df: DataFrame, label: str, swap: list[tuple[str, str]] = (), negate: list[str] = ()) -> DataFrame:
    """The same rows seen from the other side: blue_/red_ swapped, diff_ negated, label 1 - y.

    `swap` and `negate` name further columns (for instance norms and a logit).
    """
    pairs = [(c, "red_" + c[5:]) for c in df.columns if c.startswith("blue_") and "red_" + c[5:] in df.columns]
    source = {}
    for a, b in [*pairs, *swap]:
        if a in df.columns and b in df.columns:
            source[a], source[b] = b, a
    flip = {c for c in df.columns if c.startswith("diff_")} | set(negate)
    cols = []
    for c in df.columns:
        if c == label:
            cols.append((1 - F.col(c)).alias(c))
        elif c in flip:
            cols.append((-F.col(c)).alias(c))
        else:
            cols.append(F.col(source.get(c, c)).alias(c))
    return df.select(*cols)


def with_mirror(df: DataFrame, label: str, **kw) -> DataFrame:
    return df.unionByName(mirror(df, label, **kw))


def category_weight(column: str, weights: dict[str, float], default: float = 1.0) -> Column:
    out = F.lit(default)
    for value, w in weights.items():
        out = F.when(F.col(column) == value, F.lit(w)).otherwise(out)
    return out


def time_decay_weight(df: DataFrame, date_col: str, cutoff, half_life: float = 180, out: str = "weight") -> DataFrame:
    """2^(-days before cutoff / half_life), scaled to mean 1 over the table."""
    end = F.lit(cutoff).cast("date") if isinstance(cutoff, (str, date)) else cutoff
    days = F.greatest(F.date_diff(end, F.to_date(date_col)), F.lit(0))
    w = F.pow(F.lit(2.0), -days / F.lit(float(half_life)))
    raw = df.withColumn("_w", w)
    mean = raw.agg(F.avg("_w").alias("m")).scalar()
    return raw.withColumn(out, F.col("_w") / mean).drop("_w")


# League weights of the draft models.
DRAFT_LEAGUE_WEIGHTS = {"LCK": 1.0, "LPL": 1.0, "LEC": 0.7}


def sample_weight(days: Column, league: str, half_life=21.0, floor=0.05, weights=None, other=0.8) -> Column:
    decay = F.greatest(decay_weight(days, half_life), F.lit(floor))
    return decay * category_weight(league, DRAFT_LEAGUE_WEIGHTS if weights is None else weights, other)


def smooth_label(y, eps: float = 0.05) -> Column:
    return col(y) * (1 - eps) + 0.5 * eps


def noise_copies(df: DataFrame, cond: Column, cols: list[str], label: str, sigma: float = 0.01, seed: int = 42, **kw) -> DataFrame:
    """Rows plus noisy copies of one stratum and the mirrors of those copies."""
    noisy = df.filter(cond).withColumns({c: F.col(c) + F.randn(seed + i) * sigma for i, c in enumerate(cols)})
    return df.unionByName(noisy).unionByName(mirror(noisy, label, **kw))


def medians(df: DataFrame, cols: list[str], cells: int = 4096) -> DataFrame:
    """One row with the exact median of every column.

    Values are counted per distinct value, ordered inside cells of the value
    range and offset by the counts of the lower cells; the two middle
    positions are then looked up. No task holds more than one cell.
    """
    from pitloom.operators.quality import unfold

    n = unfold(df, cols).filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("c"))
    span = n.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n"))
    rows = n.join(F.broadcast(span), "feature")  # one row per column
    width = F.col("hi") - F.col("lo")
    cell = F.when(width > 0, F.floor((F.col("value") - F.col("lo")) / width * cells)).otherwise(F.lit(0).cast("long"))
    seen = prior_scan(rows, ["feature"], cell, ["value"], {"_before": ("sum", F.col("c"))})
    first = F.coalesce("_before", F.lit(0))

    def holds(pos):
        return (first < pos) & (first + F.col("c") >= pos)

    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    mid = seen.groupBy("feature").agg(
        ((F.max(F.when(holds(lower), F.col("value"))) + F.max(F.when(holds(upper), F.col("value")))) / 2).alias("m")
    )
    return mid.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(c) for c in cols])


def oof_stitch(base: DataFrame, folds: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Out-of-fold features: test rows of every fold and train rows of fold 0; the latest
    fold wins (test before train), rows without features get the column median."""
    usable = folds.filter((F.col("split") == "test") | ((F.col("fold") == 0) & (F.col("split") == "train")))
    rank = F.struct("fold", (F.col("split") == "train").cast("int"))
    one = usable.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_r")).select(key, "_r.*")
    joined = base.join(one, key, "left")
    med = medians(joined, cols).select(F.struct(*cols)).scalar()
    return joined.withColumns({c: F.coalesce(F.col(c), med[c]) for c in cols})


def median_fill(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nulls of both parts become the exact train median."""
    med = medians(train, cols).select(F.struct(*cols)).scalar()
    fill = {c: F.coalesce(F.col(c), med[c]) for c in cols}
    return train.withColumns(fill), test.withColumns(fill)


def ranking_frame(
    scores: DataFrame, q: str, cand: str, score: str, label: str, k: int = 50, split: str = "train", weight: Column | None = None
) -> DataFrame:
    """Top-k candidates per query with the label flag, the base model's score (`base_score`) and the row's `weight` (of its query's age; 1 without one).

    train: queries whose positive is not among the k are dropped; val: the
    missed positive is added. The k best are cut before the shuffle, positives
    are joined by key.
    """
    scores = scores.withColumns({"base_score": F.col(score), "weight": F.lit(1.0) if weight is None else weight})
    w = W.partitionBy(q).orderBy(F.col(score).desc(), F.col(cand).asc())
    top = scores.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    if split == "train":
        hit = top.filter(F.col(label) == 1).select(q).distinct()
        return top.join(hit, q, "left_semi")
    missed = scores.filter(F.col(label) == 1).join(top.select(q, cand), [q, cand], "left_anti")
    return top.unionByName(missed)


def standardise(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """(x - mean) / population deviation, both from train; a constant column is only centred."""
    stats = train.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])).scalar()

    def scale(c):
        st = stats[c]
        return (F.col(c) - st["m"]) / F.when(st["s"] > 0, st["s"]).otherwise(1.0)

    return [d.withColumns({c: scale(c) for c in cols}) for d in [train, *others]]


def stratified_sample(df: DataFrame, stratum: str, values: list, n: int, key: str, seed: int = 42) -> DataFrame:
    """n // len(values) rows per stratum, topped up to n from the other rows.

    Rows are ordered by a hash, so the sample does not depend on partitioning;
    each step keeps at most n rows before it shuffles.
    """
    per = max(1, n // len(values))
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    src = df.withColumn("_h", h)
    w = W.partitionBy(stratum).orderBy("_h", key)
    first = src.filter(F.col(stratum).isin(values)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per).drop("_r")
    short = F.lit(n) - first.agg(F.count("*").alias("n")).scalar()
    rest = src.join(first.select(key), key, "left_anti").orderBy("_h", key).limit(n)
    rest = rest.withColumn("_r", F.row_number().over(W.orderBy("_h", key))).filter(F.col("_r") <= short).drop("_r")
    return first.unionByName(rest).drop("_h")


def holdout(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded hold-out by an MD5 of the key: the same rows in any partitioning."""
    u = F.pmod(_place(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.lit(1_000_000))
    return df.withColumn("holdout", (u < int(frac * 1_000_000)).cast("int"))
