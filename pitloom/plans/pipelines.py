"""End-to-end plans: build the stores, write them, assemble the wide rows from the written stores.

Each store is one action; the parquet files are the materialisation boundary,
so a lost executor repeats one store at most and no lineage grows across them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.operators import derive, entity, lookups, meta, rates, stores, team
from pitloom.operators import reshape as rs
from pitloom.sources.stores_io import save_store


def prediction_stores(games: DataFrame, career: DataFrame) -> dict[str, DataFrame]:
    """Meta, player and team stores of the prediction side (equal timestamps do not see each other)."""
    history = rs.melt_players(games)
    prior = rates.base_prior(history, career)
    return {
        "meta": meta.meta_drift(history, games),
        "player": entity.player_store(history, prior),  # with the whole pool, which serving looks up
        "team": team.team_profile(rs.melt_teams(games)),
    }


def recommendation_stores(games: DataFrame, career: DataFrame, vocab: DataFrame, pairs: DataFrame) -> dict[str, DataFrame | Callable]:
    """Stores of the recommendation side (earlier games of the same day count), with the look-ups of counters and synergies from `pairs`.

    Signatures rest on the mastery that is written with the player store; they are functions of the stores written before.
    """
    history = rs.melt_players(games)
    bans = rs.melt_bans(games)
    prior = rates.base_prior(history, career)
    order = ["date", "gameid"]
    ids = vocab.withColumnRenamed("idx", "champion_id")
    grudge, grudge_latest = stores.grudge_store(games, bans.join(ids, "champion"))
    hot, hot_latest = stores.hot_streak_store(history, vocab)
    player = entity.player_store(history, prior, "sequence", 21, death_floor=1.0, seq=order, dense=False)

    def respect(written):
        return stores.respect_store(written["player"].join(ids, "champion").select("gameid", "day", "player_id", "champion_id", "mastery_score"))

    return {
        "meta": meta.meta_patch_weighted(history, bans, games),
        "player": player,
        "respect": lambda written: respect(written)[0],
        "respect_latest": lambda written: respect(written)[1],
        "counter": rates.counter_lookup(pairs),
        "synergy": rates.synergy_lookup(pairs),
        "team": team.team_style(rs.melt_teams(games)),
        "pick_distribution": entity.pick_distribution(history),
        "grudge": grudge,
        "grudge_latest": grudge_latest,
        "hot_streak": hot,
        "hot_streak_latest": hot_latest,
    }


def write_stores(frames: dict[str, DataFrame | Callable], root: str) -> dict[str, DataFrame]:
    """Write every store and return the written ones. A function is given the stores written before it."""
    out = {}
    for name, made in frames.items():
        df = made(out) if callable(made) else made
        path = f"{root.rstrip('/')}/{name}"
        save_store(df, path)
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


# What a slot without a store row is given.
SLOT_DEFAULTS = {
    "mastery_score": 32.5,
    "player_recent_kda_90d": 3.0,
    "player_recent_wr_90d": 0.5,
    "player_recent_games_90d": 0,
    "player_overall_recent_wr": 0.5,
    "player_overall_recent_kda": 3.0,
    "player_overall_recent_games": 0,
}
META_SLOT_DEFAULTS = {"meta_win_rate_pit": 0.5, "meta_patch_drift_index": 1.0, "meta_pick_drift_index": 1.0}


def assemble(games: DataFrame, written: dict[str, DataFrame], tags: DataFrame) -> DataFrame:
    """One wide row per game with base and derived features: three joins instead of twenty-two."""
    p = written["player"].select("gameid", "player_id", "champion", *SLOT_DEFAULTS)
    slots = lookups.attach_slots(games, p, ["gameid", "player_id", "champion"], SLOT_DEFAULTS)
    m = lookups.attach_slots(games, written["meta"], ["date", "champion"], META_SLOT_DEFAULTS)
    profile = {c: team.PROFILE_DEFAULTS.get(c, 0) for c in derive.TEAM_COLS}
    base = lookups.attach_team_profile(games, written["team"], profile, order=["date"])
    base = rs.normalise_flags(rs.one_hot(base, "league", ["LPL", "LCK", "LEC"]))
    wide = base.join(slots, "gameid").join(m, "gameid")
    return derive.derive_features(wide, tags, lineups=games)


def assemble_recommendation(games: DataFrame, written: dict[str, DataFrame]) -> DataFrame:
    """One row per seat of a game: the player's hot champion, signature and most picked champion, and what the team bans most against this opponent.

    Stores are written and read, so each is a narrow scan here; all joins are on the seat's own keys.
    """
    against = rs.melt_teams(games).select("gameid", "team", "opponent")
    seats = rs.melt_players(games).select("gameid", "team", "player_id", "position").join(against, ["gameid", "team"])
    most = written["pick_distribution"].filter("rank = 1").select("gameid", "player_id", F.col("pick_dist_champion").alias("most_picked"), F.col("pick_dist_pct").alias("most_picked_pct"))
    worst = written["grudge"].groupBy("gameid", "team", "opponent").agg(F.max(F.struct("rate", (-F.col("champion_id")).alias("c"))).alias("g"))
    worst = worst.select("gameid", "team", "opponent", (-F.col("g.c")).alias("grudge_champion_id"), F.col("g.rate").alias("grudge_rate"))
    out = seats.join(written["hot_streak"], ["gameid", "player_id"], "left").join(written["respect"], ["gameid", "player_id"], "left")
    return out.join(most, ["gameid", "player_id"], "left").join(worst, ["gameid", "team", "opponent"], "left")
