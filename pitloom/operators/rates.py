"""Counts, priors, smoothing and share aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.functions.columns import bayes_rate, clip, col, wins_from_rate


def pair_counts(df: DataFrame, keys: list[str], result: str = "result") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("games"), F.sum(result).alias("wins"))


def base_prior(history: DataFrame, career: DataFrame, keys=("player_id", "champion")) -> DataFrame:
    """Career totals minus what the history already holds, never below zero."""
    keys = list(keys)
    seen = pair_counts(history, keys)
    c = career.select(*keys, F.col("games").alias("_cg"), (F.col("games") * F.col("win_rate")).alias("_cw"))
    zero = F.lit(0)
    return seen.join(c, keys, "full_outer").select(
        *keys,
        F.greatest(F.coalesce("_cg", zero) - F.coalesce("games", zero), zero).cast("double").alias("base_g"),
        F.greatest(F.coalesce("_cw", zero) - F.coalesce("wins", zero), F.lit(0.0)).alias("base_w"),
    )


def career_only(history: DataFrame, career: DataFrame, keys=("player_id", "champion")) -> DataFrame:
    return career.join(history.select(*keys).distinct(), list(keys), "left_anti")


def leakage_ratio(prior: DataFrame, history: DataFrame, career: DataFrame, limit: float = 1.10) -> DataFrame:
    """(prior games + history games) / career games, and whether it passes the limit."""
    n_hist = history.agg(F.count("*").alias("n")).scalar()
    n_career = career.agg(F.sum("games").alias("n")).scalar()
    return prior.agg(F.sum("base_g").alias("_b")).select(
        ((F.col("_b") + n_hist) / n_career).alias("ratio")
    ).withColumn("leaks", F.col("ratio") > limit)


def counter_lookup(df: DataFrame, m: float = 2.0, clip_extreme: bool = False, tol: float = 0.02) -> DataFrame:
    """Smoothed win rate per directed pair, both directions made consistent.

    df: champion, opponent_name, win_rate (0-1), games, matchup_type, src (row
    order). The row with most games speaks for a direction (first one on ties);
    if both directions disagree by more than `tol`, the one with more games wins
    (on a tie the direction that came first in the data) and the other is its
    complement.
    """
    rows = df
    if clip_extreme:
        rows = rows.filter(F.col("games") >= 5).withColumn("win_rate", clip("win_rate", 0.1, 0.9))
    # the entry keeps the place of the first row of its direction, the values of the biggest
    best = F.max_by(F.struct("win_rate", "matchup_type", "games"), F.struct("games", -F.col("src")))
    one = rows.groupBy(F.trim("champion").alias("a"), F.trim("opponent_name").alias("b")).agg(
        best.alias("e"), F.min("src").alias("pos")
    )
    rev = one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("e").alias("r"), F.col("pos").alias("rpos"))
    both = one.join(rev, ["a", "b"], "left")
    clash = F.col("r").isNotNull() & (F.abs(F.col("e.win_rate") + F.col("r.win_rate") - 1) > tol) & (F.col("a") != F.col("b"))
    mine = (F.col("e.games") > F.col("r.games")) | ((F.col("e.games") == F.col("r.games")) & (F.col("pos") < F.col("rpos")))
    flipped = clash & ~mine
    rate = F.when(flipped, F.round(1 - F.col("r.win_rate"), 6)).otherwise(F.col("e.win_rate"))
    kind = F.when(flipped, F.when(F.col("r.matchup_type") == "hard", "easy").otherwise("hard")).otherwise(
        F.col("e.matchup_type")
    )
    games = F.when(flipped, F.col("r.games")).otherwise(F.col("e.games"))
    out = both.select("a", "b", rate.alias("wr"), kind.alias("matchup_type"), games.alias("g"))
    raw = clip("wr", 0.1, 0.9) if clip_extreme else F.col("wr")
    smooth = F.when(F.col("g") > 0, bayes_rate(wins_from_rate("wr", "g"), "g", m)).otherwise(raw)
    return out.select(
        F.col("a").alias("champion"), F.col("b").alias("opponent_name"), F.round(smooth, 6).alias("win_rate"), "matchup_type"
    )


def synergy_lookup(df: DataFrame, m: float = 2.0, clip_extreme: bool = False) -> DataFrame:
    """Smoothed win rate per unordered pair."""
    a, b = F.trim("champion"), F.trim("opponent_name")
    rows = df.filter((a != "") & (b != "") & (F.col("games") > 0) & F.col("win_rate").between(0, 1))
    agg = rows.groupBy(F.least(a, b).alias("champion_a"), F.greatest(a, b).alias("champion_b")).agg(
        F.sum(wins_from_rate("win_rate", "games")).alias("w"), F.sum("games").alias("g")
    )
    if clip_extreme:
        agg = agg.filter(F.col("g") >= 5).withColumn(
            "w", wins_from_rate(clip(F.col("w") / F.col("g"), 0.1, 0.9), F.col("g"))
        )
    return agg.select("champion_a", "champion_b", F.round(bayes_rate("w", "g", m), 6).alias("win_rate"))


def weighted_mean(x, w):
    return F.try_divide(F.sum(col(x) * col(w)), F.nullif(F.sum(col(w)), F.lit(0)))


def season_stats(df: DataFrame, keys: list[str], sums: list[str], means: list[str], weight: str = "picks") -> DataFrame:
    """Sums, weighted means (null without weight) and rates over total games = ceil(sum of picks / 10)."""
    agg = df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], *[weighted_mean(c, weight).alias(c) for c in means]
    )
    games = agg.agg(F.ceil(F.sum(weight) / 10).alias("n")).scalar()
    return agg.withColumn("total_games", games).withColumns(
        {
            "pick_rate": F.try_divide(F.col("picks"), F.col("total_games")),
            "ban_rate": F.try_divide(F.col("bans"), F.col("total_games")),
            "win_rate": F.try_divide(F.col("wins"), F.nullif(F.col("picks"), F.lit(0))),
        }
    )


def group_rate(df: DataFrame, keys: list[str], x: str, min_count: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(x).alias("rate"), F.count("*").alias("n")).filter(F.col("n") >= min_count)


def team_average(store: DataFrame, roster: DataFrame, features: list[str], default: dict) -> DataFrame:
    """Mean vector per (team, champion) over the team's players; a player without the champion counts as default.

    store: one row per (player_id, champion). roster: (team, player_id).
    """
    size = roster.groupBy("team").agg(F.count("*").alias("_n"))
    agg = roster.join(store, "player_id").groupBy("team", "champion").agg(
        F.count("*").alias("_k"), *[F.sum(c).alias(c) for c in features]
    )
    return agg.join(size, "team").select(
        "team",
        "champion",
        *[((F.col(c) + F.lit(default[c]) * (F.col("_n") - F.col("_k"))) / F.col("_n")).alias(c) for c in features],
    )


def null_rates(df: DataFrame, cols: list[str], limit: float = 0.30) -> DataFrame:
    """Share of nulls per column, one pass; columns above the limit are flagged."""
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    long = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rate")) for c in cols])))
    return long.withColumn("flagged", F.col("null_rate") > limit)


def coverage(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(F.count("*").alias("rows"), *[count(c).alias(f"n_{c}") for c in cols])


def mean_std(df: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """Mean and population deviation over a handful of folds or seeds, with the values in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda s: s[x])
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), listed.alias("values"))


def top_share(df: DataFrame, key: list[str], item: str, order: list[str], k: int = 5) -> DataFrame:
    """k most common items per key with their share; ties go to the item seen first."""
    n = df.groupBy(*key, item).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_f"))
    total = n.groupBy(*key).agg(F.sum("n").alias("_t"))
    w = W.partitionBy(*key).orderBy(F.col("n").desc(), "_f", item)
    top = n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.join(total, key).select(*key, item, "n", (F.col("n") / F.col("_t")).alias("share"), "rank")


def main_position_stats(df: DataFrame, key: str, position: str, presence: str, values: list[str]) -> DataFrame:
    """Per key the row of the position with most presence (ties: first position by name)."""
    best = F.min_by(F.struct(position, presence, *values), F.struct(-F.col(presence), F.col(position)))
    return df.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")


def prefer_obs(obs, raw):
    return F.when(F.coalesce(col(obs), F.lit(0.0)) != 0, col(obs)).otherwise(col(raw))


def metric_levels(df: DataFrame, sets: list[list[str]], aggs: list) -> DataFrame:
    """The same aggregates over several grouping sets in one pass."""
    cols = sorted({c for s in sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(*aggs)
