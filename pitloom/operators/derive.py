"""Derived match features: differences, side aggregates, interactions, composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.functions.columns import col, spread, total
from pitloom.operators.reshape import ROLES, SIDES

# Feature families.
PLAYER_COLS = (
    "mastery_score",
    "player_recent_kda_90d",
    "player_recent_wr_90d",
    "player_recent_games_90d",
    "player_overall_recent_wr",
    "player_overall_recent_kda",
    "player_overall_recent_games",
)
META_COLS = ("meta_win_rate_pit", "meta_patch_drift_index", "meta_pick_drift_index")
# Team columns, in the order of the studied feature list.
TEAM_COLS = (
    "team_avg_gamelength",
    "team_avg_ckpm",
    "team_avg_golddiffat15",
    "team_firstdragon_rate",
    "team_firsttower_rate",
    "team_recent_wr",
    "team_recent_wr_5",
    "team_recent_wr_10",
    "team_side_wr",
    "team_streak",
    "team_profile_games",
    "team_avg_kills",
    "team_avg_deaths",
    "team_avg_assists",
    "team_bloodiness",
    "team_snowball_rate",
    "team_led_at_15_rate",
)
TAGS = ("engage", "poke", "peel", "burst", "tank", "hardcc", "linestrength")
# Tags of a champion without an entry.
TAG_DEFAULTS = {"engage": 1, "poke": 1, "peel": 1, "burst": 1, "tank": 1, "hardcc": 1, "linestrength": 0}
# Share of the team's mean an unknown player is given.
ROOKIE_PENALTY = {
    "mastery_score": 0.3,
    "player_recent_kda_90d": 0.85,
    "player_recent_wr_90d": 0.9,
    "player_recent_games_90d": 0.0,
    "player_overall_recent_kda": 0.9,
    "player_overall_recent_wr": 0.9,
    "player_overall_recent_games": 0.2,
}


def _f(df: DataFrame, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _by_role(df, side, c, default=0.0) -> list[Column]:
    return [_f(df, f"{side}_{p}_{c}", default) for p in ROLES]


def _diffs(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({f"diff_{c}": _f(df, f"blue_{c}") - _f(df, f"red_{c}") for c in names})


def position_diffs(df: DataFrame) -> DataFrame:
    return _diffs(df, [f"{p}_{c}" for p in ROLES for c in PLAYER_COLS + META_COLS])


def side_aggregates(df: DataFrame) -> DataFrame:
    """Mean, maximum and sample deviation over the five positions, and the differences of the means."""
    made = {}
    for s in SIDES:
        for c in PLAYER_COLS:
            v = _by_role(df, s, c)
            made[f"{s}_team_avg_{c}"] = total(v) / 5
            made[f"{s}_team_max_{c}"] = F.greatest(*v)
            made[f"{s}_team_std_{c}"] = spread(v)
        for c in META_COLS:
            made[f"{s}_team_avg_{c}"] = total(_by_role(df, s, c)) / 5
    return _diffs(df.withColumns(made), [f"team_avg_{c}" for c in PLAYER_COLS + META_COLS])


def profile_diffs(df: DataFrame) -> DataFrame:
    return _diffs(df, list(TEAM_COLS))


def interactions(df: DataFrame) -> DataFrame:
    """Champion deltas, mastery products, and their differences (after `position_diffs`)."""
    made = {}
    for s in SIDES:
        for p in ROLES:
            g = lambda c, d: _f(df, f"{s}_{p}_{c}", d)
            made[f"{s}_{p}_champ_wr_delta"] = g("player_recent_wr_90d", 0.5) - g("player_overall_recent_wr", 0.5)
            made[f"{s}_{p}_champ_kda_delta"] = g("player_recent_kda_90d", 3.0) - g("player_overall_recent_kda", 3.0)
            made[f"{s}_{p}_mastery_x_presence"] = g("mastery_score", 0.0) * g("meta_presence_pit", 0.0)
            made[f"{s}_{p}_mastery_x_wr"] = g("mastery_score", 0.0) * g("meta_win_rate_pit", 0.5)
    out = _diffs(df.withColumns(made), [f"{p}_{c}" for p in ROLES for c in ("champ_wr_delta", "champ_kda_delta", "mastery_x_wr")])
    cross = {}
    for p in ROLES:
        m = _f(out, f"diff_{p}_mastery_score")
        cross[f"diff_{p}_mastery_x_meta_wr"] = m * _f(out, f"diff_{p}_meta_win_rate_pit")
        cross[f"diff_{p}_mastery_x_player_wr"] = m * _f(out, f"diff_{p}_player_overall_recent_wr")
    return out.withColumns(cross)


def balance(df: DataFrame) -> DataFrame:
    """Spread of the five win rates and team x roster win rate (after `side_aggregates`)."""
    made = {}
    for s in SIDES:
        v = _by_role(df, s, "player_overall_recent_wr", 0.5)
        made[f"{s}_team_wr_max_gap"] = F.greatest(*v) - F.least(*v)
        made[f"{s}_team_wr_balance"] = spread(v)
        made[f"{s}_team_wr_x_roster_wr"] = _f(df, f"{s}_team_recent_wr", 0.5) * _f(
            df, f"{s}_team_avg_player_overall_recent_wr", 0.5
        )
    return _diffs(df.withColumns(made), ["team_wr_max_gap", "team_wr_balance", "team_wr_x_roster_wr"])


def composition_columns(t: dict[str, Column]) -> dict[str, Column]:
    """Seven composites from the summed tags of a lineup."""
    return {
        "comp_early_power": t["linestrength"] + t["burst"] * 0.5 + t["engage"] * 0.3,
        "comp_late_power": t["tank"] + t["peel"] * 0.5,
        "comp_teamfight_score": t["engage"] + t["hardcc"] * 0.8 + t["tank"] * 0.3,
        "comp_aggression_index": (t["engage"] + t["burst"] + t["linestrength"]) / (t["peel"] + t["poke"] * 0.5 + 1),
        "comp_scaling_type": (t["peel"] + t["poke"]) / (t["engage"] + t["burst"] + 1),
        "comp_lane_dom_type": (t["linestrength"] + t["burst"]) / 10,
        "comp_teamfight_type": (t["engage"] + t["hardcc"]) / 10,
    }


def composition(df: DataFrame, tags: DataFrame, key: str = "gameid", lineups: DataFrame | None = None) -> DataFrame:
    """Tag sums, means and composites of both lineups, and their differences.

    All ten slots are unfolded and meet the tag dimension in one join. `lineups` may hold the key and champions of the rows of `df`
    where these were joined to other tables, which would be joined twice.
    """
    slots = [
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_{p}_champion").alias("champion")) for s in SIDES for p in ROLES
    ]
    long = (df if lineups is None else lineups).select(key, F.inline(F.array(*slots))).join(tags, "champion", "left")
    value = {t: F.coalesce(F.col(t), F.lit(TAG_DEFAULTS[t])).cast("double") for t in TAGS}
    sums = long.groupBy(key).agg(
        *[F.sum(F.when(F.col("side") == s, value[t])).alias(f"{s}_comp_{t}_sum") for s in SIDES for t in TAGS]
    )
    made = {}
    for s in SIDES:
        t = {x: F.col(f"{s}_comp_{x}_sum") for x in TAGS}
        made.update({f"{s}_comp_{x}_avg": t[x] / 5 for x in TAGS})
        made.update({f"{s}_{k}": v for k, v in composition_columns(t).items()})
    sums = sums.withColumns(made)
    names = [c[len("blue_") :] for c in sums.columns if c.startswith("blue_")]
    return df.join(_diffs(sums, names), key)


def style_interactions(df: DataFrame) -> DataFrame:
    made = {}
    for s in SIDES:
        aggr = _f(df, f"{s}_comp_aggression_index")
        made[f"{s}_bloodiness_x_aggression"] = _f(df, f"{s}_team_bloodiness", 1.5) * aggr
        made[f"{s}_early_power_x_snowball"] = _f(df, f"{s}_comp_early_power") * _f(df, f"{s}_team_snowball_rate", 0.5)
        made[f"{s}_ckpm_x_aggression"] = _f(df, f"{s}_team_avg_ckpm", 0.7) * aggr
        made[f"{s}_wr_x_aggression"] = _f(df, f"{s}_team_recent_wr", 0.5) * aggr
    names = ["bloodiness_x_aggression", "early_power_x_snowball", "ckpm_x_aggression", "wr_x_aggression"]
    return _diffs(df.withColumns(made), names)


FAMILIES = {
    "position_diffs": position_diffs,
    "side_aggregates": side_aggregates,
    "profile_diffs": profile_diffs,
    "interactions": interactions,
    "balance": balance,
    "style_interactions": style_interactions,
}


def derive_features(df: DataFrame, tags: DataFrame | None = None, families: list[str] | None = None, lineups: DataFrame | None = None) -> DataFrame:
    """All derived columns of a wide match row, in dependency order (`lineups`: see `composition`)."""
    wanted = [n for n in FAMILIES if families is None or n in families]
    # the join comes before the columns that need no join, so that they are not shuffled
    out, comp = df, []
    if "style_interactions" in wanted and tags is not None:
        out = composition(df, tags, lineups=lineups)
        comp = [c for c in out.columns if c not in df.columns]
    order = [c for c in out.columns if c not in comp]
    for name in wanted:
        if name == "style_interactions":
            order += comp
        out = FAMILIES[name](out)
        order += [c for c in out.columns if c not in order and c not in comp]
    return out.select(*order)


def rookie_fill(df: DataFrame, team: list[str], unknown: str, penalty: dict, default: dict) -> DataFrame:
    """Unknown players get the mean of their team's known players times a penalty.

    A team is one lineup of a few rows; means come from one window per lineup.
    """
    w = W.partitionBy(*team)
    made = {}
    for c, k in penalty.items():
        mean = F.avg(F.when(~F.col(unknown), F.col(c))).over(w)
        made[c] = F.coalesce(F.when(~F.col(unknown), F.col(c)), mean * k, F.lit(default[c]))
    return df.withColumns(made)


def pooled_pair_features(vectors: DataFrame, key: list[str], side: str, vec: str, a, b, mask: str | None = None) -> DataFrame:
    """Mean vectors of two sides per key: norms, cosine, and norm x sign(mean).

    Vectors are summed per dimension, so a busy key is pre-aggregated before
    the shuffle. A side without vectors leaves cosine 0 and norm 10.
    """
    rows = vectors if mask is None else vectors.filter(F.col(mask) == 1)
    long = rows.select(*key, F.col(side).alias("_s"), F.posexplode(vec).alias("_i", "_v"))
    is_a, is_b = F.col("_s") == a, F.col("_s") == b
    dims = long.groupBy(*key, "_i").agg(
        F.avg(F.when(is_a, F.col("_v").cast("double"))).alias("_a"), F.avg(F.when(is_b, F.col("_v").cast("double"))).alias("_b")
    )
    out = dims.groupBy(*key).agg(
        F.sqrt(F.sum(F.col("_a") * F.col("_a"))).alias("_na"),
        F.sqrt(F.sum(F.col("_b") * F.col("_b"))).alias("_nb"),
        F.sum(F.col("_a") * F.col("_b")).alias("_ab"),
        F.avg("_a").alias("_ma"),
        F.avg("_b").alias("_mb"),
    )
    cos = F.try_divide(F.col("_ab"), F.nullif(F.col("_na") * F.col("_nb"), F.lit(0.0)))
    return out.select(
        *key,
        F.coalesce(cos, F.lit(0.0)).alias("cosine"),
        F.coalesce(F.col("_na"), F.lit(10.0)).alias("norm_a"),
        F.coalesce(F.col("_nb"), F.lit(10.0)).alias("norm_b"),
        F.coalesce(F.col("_na") * F.signum("_ma"), F.lit(10.0)).alias("signed_a"),
        F.coalesce(F.col("_nb") * F.signum("_mb"), F.lit(10.0)).alias("signed_b"),
    )
