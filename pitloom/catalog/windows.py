"""Queries over trailing windows and as-of lookups (families C4-C6, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import query
from pitloom.catalog import inputs as I
from pitloom.catalog.inputs import with_inputs
from pitloom.operators.history import decayed_mean, trailing_sums

LN2 = "ln(2.0)"


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _brute(keys_eq, half_life, days, upper="h.us < t.us", x="h.value"):
    w = f"exp(-ln(2) / {half_life} * (t.us - h.us) / 86400000000.0)"
    return (w, f"{keys_eq} AND {upper} AND h.us >= t.us - {days} * CAST(86400000000 AS BIGINT)", x)


_w, _on, _ = _brute("h.user_id = t.user_id", 7.0, 10)


@query(
    "window_decayed_mean",
    with_inputs(
        f"SELECT t.event_id, round(sum({_w} * h.value) / sum({_w}), 6) AS mean_value, count(h.event_id) AS n_events "
        f"FROM ev t LEFT JOIN ev h ON {_on} GROUP BY t.event_id",
        "ev",
    ),
)
def window_decayed_mean(spark, sf):
    e = I.ev(spark, sf).select("event_id", "user_id", "ts", "value")
    d = decayed_mean(e, ["user_id"], "ts", "value", half_life=7, window=10)
    return d.select("event_id", r("mean").alias("mean_value"), F.col("mean_n").alias("n_events"))


from pitloom.functions.columns import DAY_US, micros  # noqa: E402
from pitloom.operators import asof, entity, history, meta, stores, team  # noqa: E402
from pitloom.operators import reshape as rs  # noqa: E402

DAYS = "86400000000.0"


def melted(spark, sf):
    return I.player_rows(spark, sf)


def team_rows(spark, sf):
    return rs.melt_teams(I.games(spark, sf))


# ---- E2: null-skipping mean, unbounded decay, sequence isolation ----
@query(
    "window_null_skipping_mean",
    with_inputs(
        f"SELECT t.event_id, round(sum({_w} * nullif(h.result, 0) * h.value) / nullif(sum(CASE WHEN h.result = 1 THEN {_w} END), 0), 6) AS mean_value "
        f"FROM ev t LEFT JOIN ev h ON {_on} GROUP BY t.event_id",
        "ev",
    ),
)
def window_null_skipping_mean(spark, sf):
    e = I.ev(spark, sf).withColumn("x", F.when(F.col("result") == 1, F.col("value")))
    d = decayed_mean(e, ["user_id"], "ts", "x", half_life=7, window=10)
    return d.select("event_id", r("mean").alias("mean_value"))


@query(
    "window_sequence_isolation",
    "WITH o AS (SELECT o_orderkey AS id, o_custkey % 20 AS k, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, o_totalprice AS x FROM orders) "
    "SELECT t.id, round(sum(exp(-ln(2) / 21 * (t.d - h.d)) * h.x) / sum(exp(-ln(2) / 21 * (t.d - h.d))), 4) AS mean_price, count(h.id) AS n "
    "FROM o t LEFT JOIN o h ON h.k = t.k AND h.d >= t.d - 90 AND (h.d < t.d OR (h.d = t.d AND h.id < t.id)) GROUP BY t.id",
)
def window_sequence_isolation(spark, sf):
    o = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("k"), "o_orderdate", "o_totalprice"
    )
    d = decayed_mean(o, ["k"], "o_orderdate", "o_totalprice", 21, 90, isolation="sequence", seq=["o_orderdate", "id"], run=4096)
    return d.select("id", r("mean", 4).alias("mean_price"), F.col("mean_n").alias("n"))


_STRICT = "h.day < t.day AND h.day >= t.day - 90"
_SEQ = "h.day >= t.day - 90 AND (h.day < t.day OR (h.day = t.day AND h.gameid < t.gameid))"


def _form_sql(keys, hl, cond, deaths, pre):
    w = f"exp(-ln(2) / {hl} * (t.day - h.day))"
    on = " AND ".join(f"h.{k} = t.{k}" for k in keys)
    den = f"sum({w} * {deaths})"
    num = f"sum({w} * (h.kills + h.assists))"
    return with_inputs(
        f"SELECT t.gameid, t.player_id, round(sum({w} * h.result) / sum({w}), 6) AS {pre}_wr, "
        f"round(CASE WHEN {den} > 0 THEN {num} / {den} ELSE {num} END, 6) AS {pre}_kda, count(h.gameid) AS {pre}_games "
        f"FROM player_rows t LEFT JOIN player_rows h ON {on} AND {cond} GROUP BY t.gameid, t.player_id",
        "player_rows",
    )


def _form(spark, sf, keys, hl, iso, floor):
    out = entity.entity_form(
        melted(spark, sf), keys, "date", hl, 90, iso, ["date", "gameid"], floor, prefix="form"
    )
    return out.select("gameid", "player_id", r("form_wr").alias("form_wr"), r("form_kda").alias("form_kda"), "form_games")


@query("player_form_strict", _form_sql(["player_id"], 45, _STRICT, "h.deaths", "form"))
def player_form_strict(spark, sf):
    return _form(spark, sf, ["player_id"], 45, "strict_time", None)


@query("player_form_sequence", _form_sql(["player_id"], 21, _SEQ, "greatest(h.deaths, 1)", "form"))
def player_form_sequence(spark, sf):
    return _form(spark, sf, ["player_id"], 21, "sequence", 1)


@query("player_champion_form_strict", _form_sql(["player_id", "champion"], 45, _STRICT, "h.deaths", "form"))
def player_champion_form_strict(spark, sf):
    return _form(spark, sf, ["player_id", "champion"], 45, "strict_time", None)


@query("player_champion_form_sequence", _form_sql(["player_id", "champion"], 21, _SEQ, "h.deaths", "form"))
def player_champion_form_sequence(spark, sf):
    return _form(spark, sf, ["player_id", "champion"], 21, "sequence", None)


PRIOR_TABLE_SQL = (
    "SELECT coalesce(m.player_id, c.player_id) AS player_id, coalesce(m.champion, c.champion) AS champion, "
    "greatest(coalesce(c.games, 0) - coalesce(m.n, 0), 0) AS base_g, "
    "greatest(coalesce(c.games * c.win_rate, 0) - coalesce(m.w, 0), 0) AS base_w "
    "FROM (SELECT player_id, champion, count(*) AS n, sum(result) AS w FROM player_rows GROUP BY 1, 2) m "
    "FULL JOIN career c ON c.player_id = m.player_id AND c.champion = m.champion"
)


def base_prior(spark, sf):
    from pitloom.operators.rates import base_prior as build

    return build(melted(spark, sf), I.career(spark, sf))


_WM = "exp(-ln(2) / 180 * (t.day - h.day))"


def _mastery_expr(n, wr, w, ka, d, g="coalesce(b.base_g, 0)", bw="coalesce(b.base_w, 0)"):
    base = f"(CASE WHEN {g} > 0 THEN {bw} / {g} ELSE 0.5 END)"
    return (
        f"(CASE WHEN {n} = 0 THEN {base} ELSE ({wr} + {base} * 3) / ({w} + 3) END) * 50 "
        f"+ least(ln(1 + {g} + {n}) / ln(51), 1.0) * 30 "
        f"+ least(CASE WHEN {n} = 0 THEN 3.0 WHEN {d} > 0 THEN {ka} / {d} ELSE {ka} END, 8.0) / 8 * 20"
    )


@query(
    "player_mastery",
    with_inputs(
        "SELECT a.gameid, a.player_id, round("
        + _mastery_expr("a.n", "a.wr", "a.w", "a.ka", "a.d")
        + ", 5) AS mastery_score FROM a LEFT JOIN b ON a.player_id = b.player_id AND a.champion = b.champion",
        "player_rows",
        "career",
        a=(
            f"SELECT t.gameid, t.player_id, t.champion, count(h.gameid) AS n, sum({_WM} * h.result) AS wr, sum({_WM}) AS w, "
            f"sum({_WM} * (h.kills + h.assists)) AS ka, sum({_WM} * h.deaths) AS d FROM player_rows t LEFT JOIN player_rows h "
            "ON h.player_id = t.player_id AND h.champion = t.champion AND h.day < t.day GROUP BY 1, 2, 3"
        ),
        b=PRIOR_TABLE_SQL,
    ),
)
def player_mastery(spark, sf):
    prior = base_prior(spark, sf)
    store = entity.player_store(melted(spark, sf), prior, dense=False)
    return store.select("gameid", "player_id", r("mastery_score", 5).alias("mastery_score"))


_WF = "exp(-ln(2) / 45 * (t.day - h.day))"


@query(
    "player_store_dense",
    with_inputs(
        "SELECT d.player_id, d.champion, count(*) AS n_rows, round(avg("
        + _mastery_expr("s.n", "s.wr", "s.w", "s.ka", "s.d")
        + "), 4) AS avg_mastery, round(avg(CASE WHEN s.rn > 0 THEN s.rwr / s.rw END), 4) AS avg_recent_wr, "
        "CAST(sum(s.rn) AS BIGINT) AS sum_recent_games "
        "FROM d JOIN s USING (player_id, champion, gameid) LEFT JOIN b ON d.player_id = b.player_id AND d.champion = b.champion "
        "GROUP BY 1, 2",
        "player_rows",
        "career",
        b=PRIOR_TABLE_SQL,
        pool="SELECT DISTINCT player_id, champion FROM player_rows UNION SELECT player_id, champion FROM career",
        d="SELECT g.player_id, p.champion, g.gameid, g.day FROM player_rows g JOIN pool p USING (player_id)",
        s=(
            f"SELECT t.player_id, t.champion, t.gameid, count(h.gameid) AS n, sum({_WM} * h.result) AS wr, sum({_WM}) AS w, "
            f"sum({_WM} * (h.kills + h.assists)) AS ka, sum({_WM} * h.deaths) AS d, "
            "count(CASE WHEN h.day >= t.day - 90 THEN 1 END) AS rn, "
            f"sum(CASE WHEN h.day >= t.day - 90 THEN {_WF} * h.result END) AS rwr, "
            f"sum(CASE WHEN h.day >= t.day - 90 THEN {_WF} END) AS rw "
            "FROM d t LEFT JOIN player_rows h ON h.player_id = t.player_id AND h.champion = t.champion AND h.day < t.day GROUP BY 1, 2, 3"
        ),
    ),
)
def player_store_dense(spark, sf):
    store = entity.player_store(melted(spark, sf), base_prior(spark, sf))
    return store.groupBy("player_id", "champion").agg(
        F.count("*").alias("n_rows"),
        r(F.avg("mastery_score"), 4).alias("avg_mastery"),
        r(F.avg("player_recent_wr_90d"), 4).alias("avg_recent_wr"),
        F.sum("player_recent_games_90d").alias("sum_recent_games"),
    )


@query(
    "pick_distribution",
    with_inputs(
        "SELECT gameid, player_id, champion AS pick_dist_champion, round(CAST(n AS DOUBLE) / total, 6) AS pick_dist_pct, rank FROM ("
        "SELECT *, sum(n) OVER (PARTITION BY gameid, player_id) AS total, row_number() OVER (PARTITION BY gameid, player_id "
        "ORDER BY n DESC, fd, fg, champion) AS rank FROM c) WHERE rank <= 5",
        "player_rows",
        c=(
            "SELECT t.gameid, t.player_id, h.champion, count(*) AS n, min(h.day) AS fd, arg_min(h.gameid, h.day * 1000000000 + h.gameid) AS fg "
            f"FROM player_rows t JOIN player_rows h ON h.player_id = t.player_id AND {_SEQ} GROUP BY 1, 2, 3"
        ),
    ),
)
def pick_distribution(spark, sf):
    d = entity.pick_distribution(melted(spark, sf))
    return d.select("gameid", "player_id", "pick_dist_champion", r("pick_dist_pct").alias("pick_dist_pct"), "rank")


# ---- teams ----
_WT = "exp(-ln(2) / 45 * (t.day - h.day))"


def _tavg(c):
    return f"sum(CASE WHEN h.{c} IS NOT NULL THEN {_WT} * h.{c} END) / nullif(sum(CASE WHEN h.{c} IS NOT NULL THEN {_WT} END), 0)"


_TEAM_COLS = {
    "team_avg_gamelength": ("gamelength", 1954),
    "team_avg_ckpm": ("ckpm", 0.7),
    "team_avg_golddiffat15": ("golddiffat15", 0),
    "team_firstdragon_rate": ("firstdragon", 0.5),
    "team_firsttower_rate": ("firsttower", 0.5),
    "team_avg_kills": ("total_kills", 25.0),
    "team_avg_deaths": ("total_deaths", 25.0),
    "team_avg_assists": ("total_assists", 60.0),
    "team_bloodiness": ("bloodiness", 1.5),
}


def _last(n):
    return (
        f"list_avg(list_slice(list(h.result ORDER BY h.day DESC, h.gameid DESC) FILTER (WHERE h.gameid IS NOT NULL), 1, {n}))"
    )


TEAM_PROFILE_SQL = with_inputs(
    "SELECT a.*, CAST(CASE WHEN a.team_profile_games = 0 THEN 0 ELSE coalesce(k.streak, 0) END AS BIGINT) AS team_streak "
    "FROM a JOIN k ON a.gameid = k.gameid AND a.team = k.team",
    "team_rows",
    a=(
        "SELECT t.gameid, t.team, t.side, "
        + ", ".join(f"round(coalesce({_tavg(c)}, {d}), 5) AS {o}" for o, (c, d) in _TEAM_COLS.items())
        + f", count(h.gameid) AS team_profile_games, round(coalesce(sum({_WT} * h.result) / sum({_WT}), 0.5), 6) AS team_recent_wr, "
        f"round(coalesce({_last(5)}, 0.5), 6) AS team_recent_wr_5, round(coalesce({_last(10)}, 0.5), 6) AS team_recent_wr_10, "
        "round(coalesce(CASE WHEN count(CASE WHEN h.side = t.side THEN 1 END) >= 2 THEN avg(CASE WHEN h.side = t.side THEN h.result END) END, 0.5), 6) AS team_side_wr, "
        "round(coalesce(CASE WHEN sum(h.led_at_15) >= 2 THEN avg(CASE WHEN h.led_at_15 = 1 THEN h.result END) END, 0.7), 6) AS team_snowball_rate, "
        "round(coalesce(avg(h.led_at_15), 0.5), 6) AS team_led_at_15_rate "
        f"FROM team_rows t LEFT JOIN team_rows h ON h.team = t.team AND {_STRICT} GROUP BY t.gameid, t.team, t.side"
    ),
    k=(
        "SELECT gameid, team, lag(CASE WHEN result = 1 THEN run ELSE -run END) OVER (PARTITION BY team ORDER BY day, gameid) AS streak FROM ("
        "SELECT *, row_number() OVER (PARTITION BY team, grp, result ORDER BY day, gameid) AS run FROM ("
        "SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, gameid) - row_number() OVER (PARTITION BY team, result ORDER BY day, gameid) AS grp FROM team_rows))"
    ),
)


@query("team_profile", TEAM_PROFILE_SQL)
def team_profile(spark, sf):
    p = team.team_profile(team_rows(spark, sf))
    ints = {"team_profile_games", "team_streak"}
    return p.select(
        "gameid",
        "team",
        "side",
        *[c if c in ints else r(c, 5 if c in _TEAM_COLS else 6).alias(c) for c in p.columns if c.startswith("team_")],
    )


@query(
    "team_style_sequence",
    with_inputs(
        "SELECT t.gameid, t.team, "
        + ", ".join(
            f"round(coalesce({_tavg(c)}, {1900 if c == 'gamelength' else d}), 5) AS {o}"
            for o, (c, d) in list(_TEAM_COLS.items())[:5]
        )
        + f", count(h.gameid) AS team_profile_games FROM team_rows t LEFT JOIN team_rows h ON h.team = t.team AND {_SEQ} GROUP BY t.gameid, t.team",
        "team_rows",
    ),
)
def team_style_sequence(spark, sf):
    p = team.team_style(team_rows(spark, sf))
    return p.select("gameid", "team", *[r(c, 5).alias(c) for c in team.STYLE_DEFAULTS], "team_profile_games")


@query(
    "result_streak",
    "WITH s AS (SELECT event_id, user_id, CASE WHEN value > 30 THEN 1 ELSE 0 END AS res, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) "
    "SELECT t.event_id, coalesce(CASE WHEN p.res = 1 THEN 1 ELSE -1 END * (p.i - coalesce(max(o.i), 0)), 0) AS streak "
    "FROM s t LEFT JOIN s p ON p.user_id = t.user_id AND p.i = t.i - 1 "
    "LEFT JOIN s o ON o.user_id = t.user_id AND o.i < p.i AND o.res <> p.res GROUP BY t.event_id, p.res, p.i",
)
def result_streak(spark, sf):
    e = I.ev(spark, sf).select("event_id", "user_id", "us", "result")
    s = history.streak(e, ["user_id"], F.floor(F.col("us") / F.lit(DAY_US)), ["us", "event_id"], "result")
    return s.select("event_id", "streak")


@query(
    "last_five_rate",
    "WITH s AS (SELECT o_orderkey AS id, o_custkey AS k, o_orderdate AS d, CAST(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS INT) AS res FROM orders) "
    "SELECT t.id, round(list_avg(list_slice(list(h.res ORDER BY h.d DESC, h.id DESC) FILTER (WHERE h.id IS NOT NULL), 1, 5)), 6) AS rate "
    "FROM s t LEFT JOIN s h ON h.k = t.k AND h.d < t.d AND h.d >= t.d - INTERVAL 400 DAY GROUP BY t.id",
)
def last_five_rate(spark, sf):
    o = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("k"),
        F.col("o_orderdate").alias("d"),
        F.when(F.col("o_totalprice") > 150000, 1).otherwise(0).alias("res"),
    )
    o = o.withColumn("u", micros("d"))
    out = history.last_n_rate(o, ["k"], "d", ["u", "id"], "res", 5, 400, bucket=F.floor(F.col("u") / F.lit(90 * DAY_US)))
    return out.select("id", r("rate").alias("rate"))


@query(
    "side_rate",
    with_inputs(
        f"SELECT t.gameid, t.team, round(CASE WHEN count(h.gameid) >= 2 THEN avg(h.result) END, 6) AS side_wr "
        f"FROM team_rows t LEFT JOIN team_rows h ON h.team = t.team AND h.side = t.side AND {_STRICT} GROUP BY t.gameid, t.team",
        "team_rows",
    ),
)
def side_rate(spark, sf):
    s = trailing_sums(
        team_rows(spark, sf).select("gameid", "team", "side", "date", "result"),
        ["team", "side"],
        "date",
        {"w": (F.col("result"), False), "n": (F.lit(1), False)},
    )
    return s.select("gameid", "team", r(history.conditional_rate("w", "n", 2)).alias("side_wr"))


@query(
    "conditional_snowball_rate",
    with_inputs(
        "SELECT t.gameid, t.team, round(CASE WHEN sum(h.led_at_15) >= 2 THEN avg(CASE WHEN h.led_at_15 = 1 THEN h.result END) END, 6) AS snowball_rate "
        f"FROM team_rows t LEFT JOIN team_rows h ON h.team = t.team AND {_STRICT} GROUP BY t.gameid, t.team",
        "team_rows",
    ),
)
def conditional_snowball_rate(spark, sf):
    t = team_rows(spark, sf).select("gameid", "team", "date", "led_at_15", "snowball_win")
    s = trailing_sums(t, ["team"], "date", {"led": (F.col("led_at_15"), False), "win": (F.col("snowball_win"), False)})
    return s.select("gameid", "team", r(history.conditional_rate("win", "led", 2)).alias("snowball_rate"))


# ---- meta ----
@query(
    "meta_drift",
    with_inputs(
        "SELECT champion, day, round(hist_wr, 6) AS meta_win_rate_pit, "
        "round((CASE WHEN pp > 5 THEN (pw + 1.0) / (pp + 2.0) ELSE hist_wr END) / (hist_wr + 1e-6), 6) AS meta_patch_drift_index, "
        "round((pp / 7.0 + 0.1) / (hp / 30.0 + 0.1), 6) AS meta_pick_drift_index FROM ("
        "SELECT g.champion, g.day, CAST(coalesce(h.p, 0) AS DOUBLE) AS hp, CASE WHEN coalesce(h.p, 0) > 0 THEN (h.w + 1.0) / (h.p + 2.0) ELSE 0.5 END AS hist_wr, "
        "CAST(coalesce(q.p, 0) AS DOUBLE) AS pp, CAST(coalesce(q.w, 0) AS DOUBLE) AS pw FROM grid g "
        "LEFT JOIN (SELECT g.champion, g.day, sum(a.p) AS p, sum(a.w) AS w FROM grid g JOIN agg a ON a.champion = g.champion AND a.day < g.day AND a.day >= g.day - 60 GROUP BY 1, 2) h "
        "ON h.champion = g.champion AND h.day = g.day "
        "LEFT JOIN (SELECT g.champion, g.day, sum(a.p) AS p, sum(a.w) AS w FROM grid g JOIN agg a ON a.champion = g.champion AND a.day < g.day AND a.patch = g.patch GROUP BY 1, 2) q "
        "ON q.champion = g.champion AND q.day = g.day)",
        "player_rows",
        agg="SELECT champion, patch, day, count(*) AS p, sum(result) AS w FROM player_rows GROUP BY 1, 2, 3",
        dates="SELECT day, arg_min(patch, gameid) AS patch FROM games GROUP BY day",
        grid="SELECT d.day, d.patch, c.champion FROM dates d, (SELECT DISTINCT champion FROM player_rows) c",
    ),
)
def meta_drift(spark, sf):
    m = meta.meta_drift(melted(spark, sf), I.games(spark, sf))
    from pitloom.functions.columns import day_number

    return m.select(
        "champion",
        day_number("date").alias("day"),
        *[r(c).alias(c) for c in ("meta_win_rate_pit", "meta_patch_drift_index", "meta_pick_drift_index")],
    )


_PIDX = (
    "coalesce(try_cast(split_part({p}, '.', 1) AS INT) * 24 + try_cast(split_part({p}, '.', 2) AS INT), 0)"
)


@query(
    "meta_patch_weighted",
    with_inputs(
        "SELECT a.gameid, a.champion, round(a.p / greatest(s.s, 1.0), 6) AS meta_pick_rate_pit, round(a.b / greatest(s.s, 1.0), 6) AS meta_ban_rate_pit, "
        "round((a.p + a.b) / greatest(s.s, 1.0), 6) AS meta_presence_pit, round((a.w + 1) / (a.p + 2), 6) AS meta_win_rate_pit "
        "FROM (SELECT p.gameid, e.champion, sum(p.wt * e.p) AS p, sum(p.wt * e.b) AS b, sum(p.wt * e.w) AS w FROM pr p JOIN e ON e.gameid = p.hid GROUP BY 1, 2) a "
        "JOIN (SELECT gameid, sum(wt) AS s FROM pr GROUP BY 1) s ON s.gameid = a.gameid",
        "player_rows",
        "ban_rows",
        g=f"SELECT gameid, day, {_PIDX.format(p='patch')} AS pidx FROM games",
        e=(
            "SELECT gameid, champion, sum(p) AS p, sum(b) AS b, sum(w) AS w FROM ("
            "SELECT gameid, champion, 1 AS p, 0 AS b, result AS w FROM player_rows UNION ALL SELECT gameid, champion, 0, 1, 0 FROM ban_rows) GROUP BY 1, 2"
        ),
        pr=(
            "SELECT t.gameid, h.gameid AS hid, exp(-ln(2) / 7 * (t.day - h.day)) * greatest(exp(-0.5 * abs(t.pidx - h.pidx)), 0.1) AS wt "
            "FROM g t JOIN g h ON h.day > t.day - 30 AND (h.day < t.day OR (h.day = t.day AND h.gameid < t.gameid))"
        ),
    ),
)
def meta_patch_weighted(spark, sf):
    g = I.games(spark, sf)
    m = meta.meta_patch_weighted(
        melted(spark, sf), rs.melt_bans(g), g, sub_bucket=F.floor(F.col("gameid") / F.lit(1 << 20))
    )
    return m.select(
        "gameid",
        "champion",
        *[r(c).alias(c) for c in ("meta_pick_rate_pit", "meta_ban_rate_pit", "meta_presence_pit", "meta_win_rate_pit")],
    )


# ---- cumulative stores ----
_GR = (
    "SELECT gameid, day, blue_team AS team, red_team AS opponent FROM games UNION ALL "
    "SELECT gameid, day, red_team, blue_team FROM games"
)
_BANS_ID = "SELECT b.gameid, b.day, b.team, b.opponent, v.idx AS champion_id FROM ban_rows b JOIN vocab v USING (champion)"


def bans_with_id(spark, sf):
    return rs.melt_bans(I.games(spark, sf)).join(
        I.vocab(spark, sf).withColumnRenamed("idx", "champion_id"), "champion"
    )


@query(
    "grudge_store",
    with_inputs(
        "SELECT t.gameid, t.team, t.opponent, b.champion_id, round(least(CAST(count(*) AS DOUBLE) / n.n, 1.0), 6) AS rate "
        "FROM m t JOIN bi b ON b.team = t.team AND b.opponent = t.opponent AND (b.day < t.day OR (b.day = t.day AND b.gameid < t.gameid)) "
        "JOIN n ON n.gameid = t.gameid AND n.team = t.team AND n.opponent = t.opponent GROUP BY t.gameid, t.team, t.opponent, b.champion_id, n.n",
        "ban_rows",
        "vocab",
        m=_GR,
        bi=_BANS_ID,
        n="SELECT gameid, team, opponent, row_number() OVER (PARTITION BY team, opponent ORDER BY day, gameid) - 1 AS n FROM m",
    ),
)
def grudge_store(spark, sf):
    return stores.grudge_store(I.games(spark, sf), bans_with_id(spark, sf))[0]


@query(
    "grudge_latest",
    with_inputs(
        "SELECT b.team, b.opponent, b.champion_id, round(least(CAST(count(*) AS DOUBLE) / n.n, 1.0), 6) AS rate FROM bi b "
        "JOIN (SELECT team, opponent, count(*) AS n FROM m GROUP BY 1, 2) n ON n.team = b.team AND n.opponent = b.opponent GROUP BY b.team, b.opponent, b.champion_id, n.n",
        "ban_rows",
        "vocab",
        m=_GR,
        bi=_BANS_ID,
    ),
)
def grudge_latest(spark, sf):
    return stores.grudge_store(I.games(spark, sf), bans_with_id(spark, sf))[1]


_SIG = "CAST((kills * 7 + assists * 5 + gameid % 13) AS DOUBLE)"


def mastery_rows(spark, sf):
    return (
        melted(spark, sf)
        .withColumn("champion_id", F.substring("champion", 2, 9).cast("long"))
        .withColumn("mastery_score", F.expr("CAST((kills * 7 + assists * 5 + gameid % 13) AS DOUBLE)"))
    )


_MR = f"SELECT gameid, day, player_id, CAST(substr(champion, 2) AS BIGINT) AS champion_id, {_SIG} AS ms FROM player_rows"
_FIRST = "SELECT player_id, champion_id, min(day * 1000000000 + gameid) AS f FROM mr WHERE ms > 0 GROUP BY 1, 2"


@query(
    "respect_store",
    with_inputs(
        "SELECT gameid, player_id, champion_id AS signature_champion_id, least(ms, 100.0) AS signature_mastery FROM ("
        "SELECT t.gameid, t.player_id, h.champion_id, h.ms, row_number() OVER (PARTITION BY t.gameid, t.player_id ORDER BY h.ms DESC, f.f, h.champion_id) AS rn "
        "FROM mr t JOIN mr h ON h.player_id = t.player_id AND h.ms > 0 AND (h.day < t.day OR (h.day = t.day AND h.gameid < t.gameid)) "
        "JOIN f ON f.player_id = h.player_id AND f.champion_id = h.champion_id) WHERE rn = 1",
        "player_rows",
        mr=_MR,
        f=_FIRST,
    ),
)
def respect_store(spark, sf):
    return stores.respect_store(mastery_rows(spark, sf))[0]


@query(
    "respect_latest",
    with_inputs(
        "SELECT player_id, champion_id AS signature_champion_id, least(ms, 100.0) AS signature_mastery FROM ("
        "SELECT h.*, row_number() OVER (PARTITION BY h.player_id ORDER BY h.ms DESC, f.f, h.champion_id) AS rn FROM mr h JOIN f USING (player_id, champion_id)) WHERE rn = 1",
        "player_rows",
        mr=_MR,
        f=_FIRST,
    ),
)
def respect_latest(spark, sf):
    return stores.respect_store(mastery_rows(spark, sf))[1]


_HOT_OUT = "v.idx AS hot_champion_id, round(wr, 6) AS hot_win_rate, round(ak + 1e-9, 6) AS hot_avg_kda, g AS hot_games"
_HOT_AGG = "CAST(sum(h.result) AS DOUBLE) / count(*) AS wr, round(sum((h.kills + h.assists) / greatest(h.deaths, 1)) / count(*), 9) AS kda, sum((h.kills + h.assists) / greatest(h.deaths, 1)) / count(*) AS ak, count(*) AS g"


@query(
    "hot_streak_store",
    with_inputs(
        f"SELECT gameid, player_id, {_HOT_OUT} FROM ("
        "SELECT *, row_number() OVER (PARTITION BY gameid, player_id ORDER BY wr DESC, kda DESC, f) AS rn FROM ("
        f"SELECT t.gameid, t.player_id, h.champion, {_HOT_AGG}, min(h.day * 1000000000 + h.gameid) AS f FROM player_rows t JOIN player_rows h "
        "ON h.player_id = t.player_id AND (h.day < t.day OR (h.day = t.day AND h.gameid < t.gameid)) GROUP BY 1, 2, 3 HAVING count(*) >= 2)) x "
        "JOIN vocab v ON v.champion = x.champion WHERE rn = 1",
        "player_rows",
        "vocab",
    ),
)
def hot_streak_store(spark, sf):
    h = stores.hot_streak_store(melted(spark, sf), I.vocab(spark, sf))[0]
    return h.withColumns({"hot_win_rate": r("hot_win_rate"), "hot_avg_kda": r(F.col("hot_avg_kda") + 1e-9)})


@query(
    "hot_streak_latest",
    with_inputs(
        f"SELECT player_id, {_HOT_OUT}, round(0.5 * wr + 0.3 * least(ak, 10.0) / 10 + 0.2 * least(g, 10) / 10 + 1e-9, 6) AS hot_score, "
        "round(0.5 * wr + 0.3 * least(ak, 10.0) / 10 + 1e-9, 6) AS hot_score_ban FROM ("
        "SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY wr DESC, kda DESC, f) AS rn FROM ("
        f"SELECT h.player_id, h.champion, {_HOT_AGG}, min(h.day * 1000000000 + h.gameid) AS f FROM player_rows h GROUP BY 1, 2 HAVING count(*) >= 2)) x "
        "JOIN vocab v ON v.champion = x.champion WHERE rn = 1",
        "player_rows",
        "vocab",
    ),
)
def hot_streak_latest(spark, sf):
    h = stores.hot_streak_store(melted(spark, sf), I.vocab(spark, sf))[1]
    args = ("hot_win_rate", "hot_avg_kda", "hot_games")
    return h.select(
        "player_id",
        "hot_champion_id",
        r("hot_win_rate").alias("hot_win_rate"),
        r(F.col("hot_avg_kda") + 1e-9).alias("hot_avg_kda"),
        "hot_games",
        r(stores.hot_score(*args) + 1e-9).alias("hot_score"),
        r(stores.hot_score(*args, use_games=False) + 1e-9).alias("hot_score_ban"),
    )


@query(
    "sequence_decay",
    "WITH m AS (SELECT max(event_id) AS m FROM events) SELECT user_id, round(sum(value * pow(2.0, -(m - event_id) / 500.0)) / sum(pow(2.0, -(m - event_id) / 500.0)), 5) AS value, "
    "count(*) AS n FROM events, m GROUP BY user_id",
)
def sequence_decay(spark, sf):
    e = I.table(spark, sf, "events").select("user_id", "event_id", "value")
    d = history.sequence_decay(e, ["user_id"], "event_id", "value")
    return d.select("user_id", r("value", 5).alias("value"), "n")


# ---- as-of ----
@query(
    "asof_join",
    "WITH l AS (SELECT o_orderkey AS id, o_custkey % 100 AS k, o_orderdate AS d FROM orders), "
    "s AS (SELECT l_suppkey AS k, l_shipdate AS d, l_orderkey * 100 + l_linenumber AS t, max(l_quantity) AS q, min(l_discount) AS dc FROM lineitem GROUP BY 1, 2, 3), "
    "b AS (SELECT k, d, arg_max(q, t) AS q, arg_max(dc, t) AS dc FROM s GROUP BY 1, 2) "
    "SELECT l.id, CASE WHEN date_diff('day', b.d, l.d) <= 5 THEN b.q END AS q, "
    "CASE WHEN b.d IS NULL OR date_diff('day', b.d, l.d) <= 5 THEN b.dc ELSE -1.0 END AS dc_reset FROM l ASOF LEFT JOIN b ON b.k = l.k AND b.d <= l.d",
)
def asof_join(spark, sf):
    left = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("d")
    )
    store = (
        I.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("sd"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("t"))
        .agg(F.max("l_quantity").alias("q"), F.min("l_discount").alias("dc"))
    )
    a = asof.asof_join(left, store, ["k"], "d", "sd", ["q"], max_age_days=5, tie=["t"])
    b = asof.asof_join(a, store, ["k"], "d", "sd", ["dc"], max_age_days=5, reset={"dc": -1.0}, tie=["t"])
    return b.select("id", "q", F.col("dc").alias("dc_reset"))


@query(
    "snapshot_at_cutoff",
    "WITH s AS (SELECT user_id, event_type, ts, event_id, value FROM events WHERE ts <= (SELECT min(ts) + INTERVAL 15 DAY FROM events)) "
    "SELECT user_id, event_type, arg_max(value, ts) AS value FROM s GROUP BY 1, 2",
)
def snapshot_at_cutoff(spark, sf):
    e = I.table(spark, sf, "events")
    cut = e.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("c")).scalar()
    return asof.snapshot_at(e, ["user_id", "event_type"], "ts", cut, ["value"], tie=["event_id"])


@query(
    "latest_per_key",
    "SELECT user_id, event_type, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1, 2",
)
def latest_per_key(spark, sf):
    return asof.latest(I.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "event_id"])


@query(
    "dedup_keep_last",
    "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, k) AS l_partkey FROM (SELECT *, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS dd, "
    "(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) * 100000000000 + l_partkey AS k FROM lineitem) GROUP BY 1, 2",
)
def dedup_keep_last(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    d = asof.dedup_keep(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "team_roster_asof",
    with_inputs(
        "SELECT DISTINCT team, player_id FROM player_rows WHERE day <= (SELECT max(day) - 365 FROM player_rows)", "player_rows"
    ),
)
def team_roster_asof(spark, sf):
    p = melted(spark, sf)
    cut = p.agg((F.max("day") - 365).alias("c")).scalar()
    return asof.team_players_asof(p, "team", "player_id", "day", cut)
