"""Data checks, drift and alignment reports. Every check is an aggregate; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.columns import col, finite

INF = float("inf")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def unfold(df: DataFrame, cols: list[str], keys: list[str] = (), name="feature", value="value") -> DataFrame:
    """Columns to rows (keys, feature, value) in one pass."""
    structs = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]
    return df.select(*keys, F.inline(F.array(*structs)))


def check_table(df: DataFrame, extreme: float = 1e6) -> DataFrame:
    """Per column: nulls, all-null flag, infinities, extreme values; plus row and duplicate-row counts."""
    num = set(_numeric(df))
    aggs = [F.count("*").alias("_n")]
    for c in df.columns:
        x = F.col(c).cast("double") if c in num else F.lit(None).cast("double")
        aggs.append(
            F.struct(
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.count_if(F.abs(x) == INF).alias("inf"),
                F.count_if((F.abs(x) > extreme) & (F.abs(x) < INF)).alias("extreme"),
            ).alias(c)
        )
    one = df.agg(*aggs)
    # equal rows meet by a hash of the whole row, counted before the shuffle
    rows = df.groupBy(F.xxhash64(*df.columns).alias("_a"), F.hash(*df.columns).alias("_b")).agg(F.count("*").alias("k"))
    dup = rows.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("d")).scalar()
    long = one.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in df.columns])))
    return long.select(
        "column",
        F.col("_n").alias("rows"),
        "s.nulls",
        (F.col("s.nulls") == F.col("_n")).alias("all_null"),
        "s.inf",
        "s.extreme",
    ).withColumn("duplicate_rows", dup)


def check_columns(df: DataFrame, cols: list[str], lo: float | None = None, hi: float | None = None, extreme: float = 1e6) -> DataFrame:
    """NaN, infinity, range and mean per numeric column."""
    aggs = []
    for c in cols:
        x, ok = F.col(c).cast("double"), finite(c)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (ok < lo)
        if hi is not None:
            bad = bad | (ok > hi)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.isnan(x)).alias("nan"),
                F.count_if(F.abs(x) == INF).alias("inf"),
                F.min(ok).alias("min"),
                F.max(ok).alias("max"),
                F.avg(ok).alias("mean"),
                F.count_if(bad).alias("out_of_range"),
                F.count_if(F.abs(ok) > extreme).alias("extreme"),
            ).alias(c)
        )
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in cols])))


def check_labels(df: DataFrame, y: str, low: float = 0.01) -> DataFrame:
    """Rows per label with the share, single-class and minority flags."""
    n = df.groupBy(y).agg(F.count("*").alias("n"))
    tot = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.min("n").alias("m"))
    t, k, m = (tot.select(c).scalar() for c in ("t", "k", "m"))
    return n.select(
        y, "n", (F.col("n") / t).alias("share"), (k == 1).alias("single_class"), ((k > 1) & (m / t < low)).alias("imbalanced")
    )


def check_groups(df: DataFrame, q: str, biggest: int = 500) -> DataFrame:
    sizes = df.groupBy(q).agg(F.count("*").alias("n"))
    rows = df.agg(F.count("*").alias("r")).scalar()
    return sizes.agg(
        F.count("*").alias("groups"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.count_if(F.col("n") > biggest).alias("too_big"),
        F.sum("n").alias("total"),
    ).withColumn("total_matches", F.col("total") == rows)


def check_predictions(df: DataFrame, p: str) -> DataFrame:
    x = F.col(p).cast("double")
    return df.agg(
        F.count_if(F.isnan(x)).alias("nan"),
        F.count_if(F.abs(x) == INF).alias("inf"),
        F.min(finite(p)).alias("min"),
        F.max(finite(p)).alias("max"),
        (F.coalesce(F.stddev_pop(finite(p)), F.lit(0.0)) < 1e-8).alias("constant"),
    )


# Range per part of a feature name; the first part that matches counts.
FEATURE_RANGES = (
    ("league_", 0.0, 1.0),
    ("is_playoff", 0.0, 1.0),
    ("is_blue_map_side", 0.0, 1.0),
    ("mastery_score", 0.0, 150.0),
    ("player_recent_kda", 0.0, 50.0),
    ("player_recent_wr", 0.0, 1.0),
    ("player_overall_recent_wr", 0.0, 1.0),
    ("player_overall_recent_kda", 0.0, 50.0),
    ("player_overall_recent_games", 0.0, 10000.0),
    ("meta_win_rate_pit", 0.0, 1.0),
    ("meta_pick_rate_pit", 0.0, 1.0),
    ("meta_ban_rate_pit", 0.0, 1.0),
    ("meta_presence_pit", 0.0, 1.0),
    ("meta_patch_drift_index", 0.0, 10.0),
    ("meta_pick_drift_index", 0.0, 10.0),
    ("team_avg_gamelength", 900.0, 4000.0),
    ("team_avg_ckpm", 0.0, 5.0),
    ("team_avg_golddiffat15", -10000.0, 10000.0),
    ("team_firstdragon_rate", 0.0, 1.0),
    ("team_firsttower_rate", 0.0, 1.0),
    ("team_recent_wr", 0.0, 1.0),
    ("team_side_wr", 0.0, 1.0),
    ("team_streak", -20.0, 20.0),
    ("team_profile_games", 0.0, 10000.0),
    ("team_avg_kills", 0.0, 100.0),
    ("team_avg_deaths", 0.0, 100.0),
    ("team_avg_assists", 0.0, 200.0),
    ("team_bloodiness", 0.0, 5.0),
    ("team_snowball_rate", 0.0, 1.0),
    ("team_led_at_15_rate", 0.0, 1.0),
    ("comp_", 0.0, 50.0),
    ("champ_wr_delta", -1.0, 1.0),
    ("champ_kda_delta", -50.0, 50.0),
    ("mastery_x_", 0.0, 150.0),
    ("team_wr_max_gap", -1.0, 1.0),
    ("team_wr_balance", 0.0, 1.0),
    ("team_wr_x_roster_wr", 0.0, 1.0),
    ("bloodiness_x_aggression", -20.0, 20.0),
    ("early_power_x_snowball", -20.0, 20.0),
    ("ckpm_x_aggression", -20.0, 20.0),
    ("wr_x_aggression", -20.0, 20.0),
    ("tf_win_logits", -100.0, 100.0),
    ("tf_cosine_sim", -1.0, 1.0),
    ("tf_blue_l2norm", 0.0, 100.0),
    ("tf_red_l2norm", 0.0, 100.0),
    ("champion_", 0.0, 1.0),
)
# Range of each candidate column (whole name); columns not listed have ANY_RANGE.
CANDIDATE_RANGES = (
    ("meta_pick", -1e-6, 1.0 + 1e-6),
    ("meta_ban", -1e-6, 1.0 + 1e-6),
    ("meta_presence", -1e-6, 1.0 + 1e-6),
    ("meta_wr", -1e-6, 1.0 + 1e-6),
    ("player_mastery", 0.0, 150.0),
    ("player_recent_kda", 0.0, 100.0),
    ("player_recent_wr", 0.0, 1.0),
    ("player_overall_kda", 0.0, 100.0),
    ("player_overall_wr", 0.0, 1.0),
    ("player_overall_games", 0.0, 10000.0),
    ("pos_top", 0.0, 1.0),
    ("pos_jng", 0.0, 1.0),
    ("pos_mid", 0.0, 1.0),
    ("pos_bot", 0.0, 1.0),
    ("pos_sup", 0.0, 1.0),
    ("ally_synergy", 0.0, 1.0),
    ("enemy_synergy", 0.0, 1.0),
    ("enemy_counter", 0.0, 1.0),
    ("ally_counter", 0.0, 1.0),
    ("ally_role_fit", 0.0, 1.2),
    ("enemy_role_fit", 0.0, 1.2),
    ("is_pick", 0.0, 1.0),
    ("enemy_mastery_max", 0.0, 150.0),
    ("enemy_mastery_mean", 0.0, 150.0),
    ("ban_step", 0.0, 20.0),
    ("grudge", 0.0, 1.0),
    ("respect", 0.0, 1.0),
    ("hot_streak", 0.0, 10.0),
    ("n_ally_picked", 0.0, 5.0),
    ("is_red_side", 0.0, 1.0),
    ("last_ally_synergy", 0.0, 1.0),
    ("is_fearless_banned", 0.0, 1.0),
    ("player_recent_games", 0.0, 1000.0),
)
# Range of each place of the game context vector.
CONTEXT_RANGES = (
    ("league_LPL", 0.0, 1.0),
    ("league_LCK", 0.0, 1.0),
    ("league_LEC", 0.0, 1.0),
    ("blue_team_avg_ckpm", 0.0, 5.0),
    ("blue_team_avg_golddiffat15", -10000.0, 10000.0),
    ("blue_team_avg_gamelength", 900.0, 4000.0),
    ("blue_team_firstdragon_rate", 0.0, 1.0),
    ("blue_team_firsttower_rate", 0.0, 1.0),
    ("red_team_avg_ckpm", 0.0, 5.0),
    ("red_team_avg_golddiffat15", -10000.0, 10000.0),
    ("red_team_avg_gamelength", 900.0, 4000.0),
    ("red_team_firstdragon_rate", 0.0, 1.0),
    ("red_team_firsttower_rate", 0.0, 1.0),
    ("is_playoffs", 0.0, 1.0),
    ("first_pick_map_side", 0.0, 1.0),
    ("is_game_1", 0.0, 1.0),
    ("is_game_2", 0.0, 1.0),
    ("is_game_3", 0.0, 1.0),
    ("is_game_4", 0.0, 1.0),
    ("is_game_5", 0.0, 1.0),
)
ANY_RANGE = (-10000.0, 10000.0)


def feature_range(name: str, rules=FEATURE_RANGES, default=ANY_RANGE) -> tuple[float, float]:
    """Range of a feature by name; a diff_ column may span the width of the range both ways."""
    base = name.removeprefix("diff_")
    hit = next(((lo, hi) for k, lo, hi in rules if k in base), None)
    if hit is None:
        return default
    return (-(hit[1] - hit[0]), hit[1] - hit[0]) if name.startswith("diff_") else hit


def exact_range(name: str, rules, default=ANY_RANGE) -> tuple[float, float]:
    """Range of a column by its whole name."""
    return next(((lo, hi) for k, lo, hi in rules if k == name), default)


def validate_ranges(df: DataFrame, cols: list[str], rules=FEATURE_RANGES, keys: list[str] = (), whole_names: bool = False) -> DataFrame:
    """Rows (keys, feature, value, lo, hi) for every value outside its range.

    Ranges are resolved from the names while the plan is built (`whole_names`: as they are, for CANDIDATE_RANGES and
    CONTEXT_RANGES; otherwise by part of a name); the data is read once and only violations are unfolded.
    """
    found = []
    for c in cols:
        lo, hi = (exact_range if whole_names else feature_range)(c, rules)
        x = F.col(c).cast("double")
        entry = F.struct(F.lit(c).alias("feature"), x.alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        found.append(F.when((x < lo) | (x > hi) | F.isnan(x), entry))
    return df.select(*keys, F.inline(F.filter(F.array(*found), lambda v: v.isNotNull())))


def validate_integrity(df: DataFrame, cols: list[str], expected: list[str], binary: list[str] = ()) -> DataFrame:
    """Column count and order, non-finite values, all-zero rows and columns, non-binary masks."""
    nums = [F.col(c).cast("double") for c in cols]
    bad = sum((F.when(finite(c).isNull(), 1).otherwise(0) for c in nums[1:]), F.when(finite(nums[0]).isNull(), 1).otherwise(0))
    zero_row = F.lit(True)
    for x in nums:
        zero_row = zero_row & (F.coalesce(x, F.lit(0.0)) == 0)
    aggs = [F.count("*").alias("rows"), F.sum(bad).alias("non_finite"), F.count_if(zero_row).alias("zero_rows")]
    zero_cols = [F.when(F.max(F.abs(F.coalesce(x, F.lit(0.0)))) == 0, 1).otherwise(0) for x in nums]
    aggs.append(sum(zero_cols[1:], zero_cols[0]).alias("zero_columns"))
    not_bin = [F.count_if(~F.col(c).isin(0, 1)) for c in binary]
    aggs.append((sum(not_bin[1:], not_bin[0]) if not_bin else F.lit(0)).cast("long").alias("non_binary"))
    return df.agg(*aggs).withColumns(
        {"columns_match": F.lit(sorted(cols) == sorted(expected)), "order_match": F.lit(list(cols) == list(expected))}
    )


# ---- drift ----
def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin (0-based) of a value; null outside the edges; the last bin is closed."""
    width = hi - lo
    b = F.least(F.floor((x - lo) / width * bins), F.lit(bins - 1))
    return F.when((x >= lo) & (x <= hi) & (width > 0), b)


def _widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    """A constant feature gets half a unit of room on both sides."""
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def _counts(binned: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Array of bin counts per key: one row per (key, bin) is shuffled."""
    n = binned.filter(F.col("_bin").isNotNull()).groupBy(*keys, "_bin").agg(F.count("*").alias("_c"))
    m = n.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_c"))).alias("_m"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    return m.select(*keys, F.transform(slots, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double")).alias("counts"))


def psi_baseline(df: DataFrame, cols: list[str], bins: int = 10, min_values: int = 10) -> DataFrame:
    """Ten equal-width bins over the finite values of every feature: counts and edges."""
    rows = unfold(df, cols).select("feature", finite("value").alias("value")).filter(F.col("value").isNotNull())
    span = rows.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    lo, hi = _widened(F.col("lo"), F.col("hi"))
    span = span.filter(F.col("n") >= min_values).select("feature", lo.alias("lo"), hi.alias("hi"))
    binned = rows.join(F.broadcast(span), "feature").withColumn("_bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    return _counts(binned, ["feature"], bins).join(span, "feature").select("feature", "counts", edges.alias("bin_edges"))


def psi_value(base: Column, cur: Column, eps: float = 1e-6) -> Column:
    """Population stability index of two count arrays."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    bt, ct = add(base), F.greatest(add(cur), F.lit(1.0))
    terms = F.zip_with(
        base,
        cur,
        lambda b, c: (F.greatest(c / ct, F.lit(eps)) - F.greatest(b / bt, F.lit(eps)))
        * F.ln(F.greatest(c / ct, F.lit(eps)) / F.greatest(b / bt, F.lit(eps))),
    )
    return F.when(bt == 0, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def psi(baseline: DataFrame, df: DataFrame, by: list[str] = (), min_values: int = 0, legacy: bool = False) -> DataFrame:
    """Index per feature (and group) of the current rows against a baseline.

    Values outside the baseline's edges fall out of the counts; no current
    value gives 1, an empty baseline 0. `legacy`: the baseline has no edges,
    and the current minimum and maximum are cut into bins instead. `baseline`
    has one row per feature, which bounds what is broadcast.
    """
    by, bins = list(by), 10
    cols = [c for c in _numeric(df) if c not in by]
    rows = unfold(df, cols, by).select(*by, "feature", finite("value").alias("value")).filter(F.col("value").isNotNull())
    span = rows.groupBy(*by, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    if legacy:
        lo, hi = _widened(F.col("lo"), F.col("hi"))
        edges = span.select(*by, "feature", lo.alias("lo"), hi.alias("hi"))
        placed = rows.join(edges if by else F.broadcast(edges), [*by, "feature"])
    else:
        edges = baseline.select("feature", F.element_at("bin_edges", 1).alias("lo"), F.element_at("bin_edges", -1).alias("hi"))
        placed = rows.join(F.broadcast(edges), "feature")
    cur = _counts(placed.withColumn("_bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins)), [*by, "feature"], bins)
    cur = span.select(*by, "feature", "n").join(cur, [*by, "feature"], "left")
    out = baseline.select("feature", F.col("counts").alias("_base")).join(cur, "feature", "left")
    empty = F.array(*[F.lit(0.0)] * bins)
    value = F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(psi_value(F.col("_base"), F.coalesce("counts", empty)))
    res = out.select(*by, "feature", F.coalesce("n", F.lit(0)).alias("n"), value.alias("psi"))
    return res.filter(F.col("n") >= min_values) if min_values else res


def drift_report(psi_rows: DataFrame, by: list[str], threshold: float = 0.25) -> DataFrame:
    """Per model: features compared, drifted ones (most drifted first), maximum and band."""
    entry = F.struct((-F.col("psi")).alias("p"), F.col("feature").alias("f"))
    drifted = F.transform(F.array_sort(F.collect_list(F.when(F.col("psi") >= threshold, entry))), lambda e: e["f"])
    m = F.col("max_psi")
    return psi_rows.groupBy(*by).agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("psi") >= threshold).alias("n_drifted"),
        F.max("psi").alias("max_psi"),
        drifted.alias("drifted"),
    ).withColumn("band", F.when(m < 0.1, "stable").when(m < 0.25, "moderate").otherwise("significant"))


#: Buckets of the hash range whose sizes are counted before a sample is cut.
_SAMPLE_BUCKETS = 1 << 16


def sample_cap(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """At most n rows, those of smallest MD5 of seed and key: the same rows in any partitioning and engine.

    Sizes of hash buckets are counted first (a sum that merges map-side, _SAMPLE_BUCKETS numbers in all); whole buckets below the
    cut are taken by a filter, and only the bucket at the cut is ordered. Rows with equal keys are cut in no given order.
    """
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key))), 1, 15), 16, 10).cast("long")
    own = "_place"
    rows = df.withColumn(own, place)
    bucket = F.floor(F.col(own) / ((1 << 60) // _SAMPLE_BUCKETS))
    left, cut = n, _SAMPLE_BUCKETS
    for at, size in sorted(rows.groupBy(bucket).count().collect()):
        if size > left:
            cut = at
            break
        left -= size
    edge = rows.filter(bucket == cut).orderBy(own, *key).limit(left)
    return rows.filter(bucket < cut).union(edge).drop(own)


# ---- alignment ----
def align_tables(a: DataFrame, b: DataFrame, key: list[str], tol: float = 1e-4, fuzzy: dict | None = None, skip: set = frozenset()) -> DataFrame:
    """Per shared numeric column: rows compared, largest difference, one-sided nulls, verdict."""
    fuzzy = fuzzy or {}
    cols = [c for c in _numeric(a) if c in set(_numeric(b)) and c not in key and c not in skip]
    left = a.select(*key, F.struct(*cols).alias("_a"))
    right = b.select(*key, F.struct(*cols).alias("_b"))
    j = left.join(right, key, "full_outer")
    aggs = []
    for c in cols:
        x, y = F.col(f"_a.{c}").cast("double"), F.col(f"_b.{c}").cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x - y).alias("compared"),
                F.max(F.abs(x - y)).alias("max_diff"),
                F.count_if(x.isNull() != y.isNull()).alias("one_sided"),
                F.lit(float(fuzzy.get(c, tol))).alias("tolerance"),
            ).alias(c)
        )
    long = j.agg(*aggs).select(F.inline(F.array(*[F.col(c) for c in cols])))
    ok = (F.coalesce("max_diff", F.lit(0.0)) <= F.col("tolerance")) & (F.col("one_sided") == 0)
    return long.withColumn("aligned", ok)


def align_predictions(a: DataFrame, b: DataFrame, key: list[str], p: str = "p") -> DataFrame:
    """Difference of two prediction tables with the pass rule (at most 20 % off, none above 1e-4)."""
    d = F.abs(F.col("_x") - F.col("_y"))
    j = a.select(*key, F.col(p).alias("_x")).join(b.select(*key, F.col(p).alias("_y")), key)
    agg = j.agg(
        F.count("*").alias("total"),
        F.avg(d).alias("mean_diff"),
        F.stddev_pop(d).alias("std_diff"),
        F.max(d).alias("max_diff"),
        F.count_if(d >= 1e-6).alias("mismatch"),
        F.count_if(d >= 1e-4).alias("far_off"),
    )
    passed = (F.col("mismatch") == 0) | ((F.col("max_diff") < 1e-4) & (F.col("mismatch") <= F.col("total") * 0.2))
    return agg.withColumn("passed", passed)


def align_rankings(df: DataFrame, q: str, a: str, b: str, cand: str, k: int = 20, label: str | None = None) -> DataFrame:
    """Per query: rank correlation (average ranks), top-k overlap, same best, label ranks, verdict."""
    r = df.select(q, a, b, cand, *([label] if label is not None and label not in (q, a, b, cand) else []))
    # one sort for each score: ranks are taken downwards in the order of the positions, which leaves their correlation as it is
    for c, rank, place in ((a, "_ra", "_pa"), (b, "_rb", "_pb")):
        down = W.partitionBy(q).orderBy(F.col(c).desc())
        r = r.withColumn(place, F.row_number().over(W.partitionBy(q).orderBy(F.col(c).desc(), cand)))
        ties = F.count("*").over(down.rangeBetween(W.currentRow, W.currentRow))
        r = r.withColumns({"_up": F.rank().over(down), "_ties": ties}).withColumn(rank, F.col("_up") + (F.col("_ties") - 1) / 2).drop("_up", "_ties")
    aggs = [
        F.corr("_ra", "_rb").alias("spearman"),
        F.count_if((F.col("_pa") <= k) & (F.col("_pb") <= k)).alias("overlap"),
        F.least(F.lit(k), F.count("*")).alias("depth"),
        (F.count_if((F.col("_pa") == 1) & (F.col("_pb") == 1)) == 1).alias("top1_match"),
    ]
    if label is not None:
        aggs += [F.min(F.when(F.col(label) == 1, F.col(x))).alias(n) for x, n in (("_pa", "label_rank_a"), ("_pb", "label_rank_b"))]
    out = r.groupBy(q).agg(*aggs)
    verdict = (
        F.when((F.col("spearman") > 0.99) & F.col("top1_match"), "pass")
        .when((F.col("spearman") > 0.95) & (F.col("overlap") >= F.col("depth") * 0.8), "acceptable")
        .otherwise("mismatch")
    )
    return out.withColumn("verdict", verdict)
