"""Exploratory reports over season, draft and pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.operators.lookups import compare_periods


def presence(stats: DataFrame, n: int = 15) -> DataFrame:
    """Most present champions: picks + bans with their rates (season statistics rows)."""
    out = stats.withColumns({"total": F.col("picks") + F.col("bans"), "presence_rate": F.col("pick_rate") + F.col("ban_rate")})
    return out.orderBy(F.col("total").desc(), "champion").limit(n)


def top_by_position(stats: DataFrame, by: str = "pick_rate", n: int = 8, position: str = "position", tie: str = "champion") -> DataFrame:
    w = W.partitionBy(position).orderBy(F.col(by).desc(), tie)
    return stats.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def outliers(stats: DataFrame, pick: float, win: float, n: int = 10) -> DataFrame:
    """Often picked but losing, and rarely picked but winning, up to n of each."""
    low = stats.filter((F.col("pick_rate") > pick) & (F.col("win_rate") < win)).orderBy("win_rate", "champion").limit(n)
    high = stats.filter((F.col("pick_rate") <= pick) & (F.col("win_rate") >= win)).orderBy(F.col("win_rate").desc(), "champion").limit(n)
    return low.withColumn("kind", F.lit("popular_weak")).unionByName(high.withColumn("kind", F.lit("rare_strong")))


def top_pairs(pairs: DataFrame, category: str, by: str, n: int = 10, tie: list[str] = ()) -> DataFrame:
    w = W.partitionBy(category).orderBy(F.col(by).desc(), *tie)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def pair_heatmap(pairs: DataFrame, a: str, b: str, rate: str, weight: str, values: list[str]) -> DataFrame:
    """Mean rate x 100 of the given items (rows) against the given items (columns)."""
    rows = pairs.filter(F.col(a).isin(values) & F.col(b).isin(values))
    return rows.groupBy(a).pivot(b, values).agg(F.round(F.avg(rate) * 100, 4))


def heatmap_long(pairs: DataFrame, a: str, b: str, rate: str, weight: str, n: int = 10) -> DataFrame:
    """Long form of the heat map over the n items of most weight on either side."""
    def top(c):
        return pairs.groupBy(c).agg(F.sum(weight).alias("_w")).orderBy(F.col("_w").desc(), c).limit(n).select(c)

    rows = pairs.join(top(a), a, "left_semi").join(top(b), b, "left_semi")
    return rows.groupBy(a, b).agg((F.avg(rate) * 100).alias("rate_pct"))


def daily_trend(rows: DataFrame, item: str, day: str, n: int = 10) -> DataFrame:
    """Count per day of the n most frequent items."""
    top = rows.groupBy(item).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), item).limit(n).select(item)
    return rows.join(top, item, "left_semi").groupBy(day, item).agg(F.count("*").alias("n"))


def side_top(rows: DataFrame, side: str, item: str, n: int = 10) -> DataFrame:
    c = rows.groupBy(side, item).agg(F.count("*").alias("n"))
    w = W.partitionBy(side).orderBy(F.col("n").desc(), item)
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def core3(df: DataFrame, picks: list[str], result: str, min_count: int = 2) -> DataFrame:
    """Sorted first three picks as a composition: games and win rate."""
    comp = F.array_join(F.array_sort(F.array(*[F.col(p) for p in picks[:3]])), "+")
    return df.groupBy(comp.alias("core")).agg(F.count("*").alias("n"), F.avg(result).alias("win_rate")).filter(F.col("n") >= min_count)


def best_duos(df: DataFrame, slots: list[tuple[str, str]], result: str, min_count: int = 2, n: int = 5) -> DataFrame:
    """Best champion pair per position pair; df has one row per (game, side) with a column per position.

    Pairs of positions are unfolded from the row, so no self join is needed.
    """
    pairs = [
        F.struct(F.lit(f"{x}-{y}").alias("lane"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in slots
    ]
    long = df.select(result, F.inline(F.array(*pairs)))
    agg = long.groupBy("lane", "a", "b").agg(F.count("*").alias("n"), F.avg(result).alias("win_rate")).filter(F.col("n") >= min_count)
    w = W.partitionBy("lane").orderBy(F.col("win_rate").desc(), F.col("n").desc(), "a", "b")
    return agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def template_fill(cores: DataFrame, stats: DataFrame, synergy: DataFrame, counters: DataFrame, n: int = 5) -> DataFrame:
    """Best fourth champions for a three-champion core: meta 35 + synergy 35 + counter 20 + attributes 10.

    cores: core (array of three). stats: champion, position, pick_rate,
    win_rate, ban_rate, kda, dpm, gpm. synergy: a, b, win_rate, score (both
    directions). counters: champion, opponent_name, opponent_win_rate,
    matchup_type. The champions are one small array per plan, so cores are
    unfolded against them without a join.
    """
    pick, win, ban = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("pick_rate", "win_rate", "ban_rate"))
    meta = F.least(pick * 75, F.lit(15.0)) + F.least(win * 30, F.lit(15.0)) + F.least(ban * 30, F.lit(5.0))
    attr = F.least(F.col("kda"), F.lit(4.0)) + F.least(F.col("dpm") / 200, F.lit(3.0)) + F.least(F.col("gpm") / 100, F.lit(3.0))
    syn = synergy.select(F.col("a").alias("champion"), F.struct(F.col("b").alias("key"), (F.least(F.col("score") / 10, F.lit(12.0)) + F.least(F.col("win_rate") * 10, F.lit(5.0))).alias("value")).alias("_e"))
    syn = syn.groupBy("champion").agg(F.map_from_entries(F.collect_list("_e")).alias("_syn"))
    easy = counters.filter(F.col("matchup_type") == "easy").groupBy("champion", "opponent_name").agg(
        F.sum(3 + F.coalesce("opponent_win_rate", F.lit(0.0)) * 100 - 50).alias("v")
    )
    easy = easy.groupBy("champion").agg(F.map_from_entries(F.collect_list(F.struct("opponent_name", "v"))).alias("_ctr"))
    dim = stats.withColumns({"_meta": F.round(meta, 2), "_attr": F.round(attr, 2)}).select("champion", "position", "_meta", "_attr")
    dim = dim.join(syn, "champion", "left").join(easy, "champion", "left")
    owner = stats.groupBy("champion").agg(F.max_by("position", F.struct("picks", "position")).alias("p"))
    home = owner.agg(F.map_from_entries(F.collect_list(F.struct("champion", "p"))).alias("m"))
    keys = stats.agg(F.array_sort(F.collect_set(F.struct("champion", "position"))).alias("a"))
    rows = cores.withColumns({"_home": home.scalar(), "_keys": keys.scalar()})
    taken = F.transform("core", lambda c: F.coalesce(F.try_element_at(F.col("_home"), c), F.lit("")))
    # unfolded first and filtered after: a filter inside the unfolded array would be worked out again for each row that a core was counted from
    rows = rows.withColumn("_taken", taken).select(*cores.columns, "_taken", F.inline("_keys"))
    used = [F.coalesce(F.array_contains(x, F.col(y)), F.lit(True)) for x, y in (("_taken", "position"), ("core", "champion"))]
    rows = rows.filter(~used[0] & ~used[1]).drop("_taken")
    rows = rows.join(dim, ["champion", "position"])

    def add(m):
        return F.aggregate("core", F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(F.col(m), c), F.lit(0.0)))

    rows = rows.withColumns(
        {"synergy": F.round(F.least(add("_syn") / F.size("core"), F.lit(35.0)), 2), "counter": F.round(F.least(add("_ctr"), F.lit(20.0)), 2)}
    )
    rows = rows.withColumn("total", F.round(F.col("_meta") + F.col("synergy") + F.col("counter") + F.col("_attr"), 2))
    key = F.array_join("core", "+")
    w = W.partitionBy(key).orderBy(F.col("total").desc(), "champion", "position")
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.select(key.alias("core"), "rank", "champion", "position", F.col("_meta").alias("meta"), "synergy", "counter", F.col("_attr").alias("attributes"), "total")


def split_change(before: DataFrame, after: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """Biggest risers and fallers between two periods."""
    c = compare_periods(before, after, [key], [value])
    d = F.col(f"{value}_change")
    up = c.filter(d > 0).orderBy(d.desc(), key).limit(n).withColumn("kind", F.lit("riser"))
    down = c.filter(d < 0).orderBy(d.asc(), key).limit(n).withColumn("kind", F.lit("faller"))
    return up.unionByName(down)


def counters_top(pairs: DataFrame, champions: DataFrame, n: int = 3) -> DataFrame:
    """Hardest and easiest opponents of some champions."""
    rows = pairs.join(champions.select("champion"), "champion", "left_semi")
    order = F.when(F.col("matchup_type") == "hard", F.col("win_rate")).otherwise(-F.col("win_rate"))
    w = W.partitionBy("champion", "matchup_type").orderBy(order, "opponent_name", "src")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def group_diff(a: DataFrame, b: DataFrame, key: str, rate: str, floor: float, n: int = 10) -> DataFrame:
    """Largest absolute rate differences between two groups; rows level with the n-th stay."""
    c = compare_periods(a, b, [key], [rate])
    rows = c.filter((F.col(f"{rate}_before") + F.col(f"{rate}_after")) / 2 > floor).withColumn("_d", F.abs(f"{rate}_change"))
    edge = rows.select("_d").orderBy(F.col("_d").desc()).limit(n).agg(F.min("_d").alias("m")).scalar()
    return rows.filter(F.col("_d") >= edge).drop("_d")


def summary(games: DataFrame, picks: DataFrame) -> DataFrame:
    """One row of facts: games, champions, blue win rate, mean length."""
    g = games.agg(F.count("*").alias("games"), F.avg("result").alias("blue_win_rate"), F.avg("gamelength").alias("mean_length"))
    return g.withColumn("champions", picks.agg(F.count_distinct("champion").alias("n")).scalar())
