"""Queries for candidate features, ranking and rules (families I, J, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import inputs as I
from pitloom.catalog import query
from pitloom.catalog import rates_queries as RQ
from pitloom.catalog import reshaping as RS
from pitloom.catalog.inputs import with_inputs
from pitloom.operators import candidates as C
from pitloom.operators import draft, rates, rules
from pitloom.operators import ranking as R
from pitloom.operators.reshape import ROLES, SIDES


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# every step of every game; query_id = gameid * 20 + step
def draft_queries(spark, sf):
    g = I.games(spark, sf)
    arrays = draft.draft_arrays(RS.long_draft(spark, sf)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(19))))
    state = draft.draft_state(arrays).withColumn("label", F.element_at("seq", F.col("step") + 1))
    pids = {s: F.array(*[F.col(f"{s}_{p}_player_id") for p in ROLES]) for s in SIDES}
    seats = g.select("gameid", "blue_team", "red_team", "prev_game_champs", *[pids[s].alias(f"{s}_pids") for s in SIDES])
    q = state.join(seats, "gameid")
    blue = F.col("side") == "blue"
    return q.select(
        (F.col("gameid") * 20 + F.col("step")).alias("query_id"),
        "gameid",
        "step",
        "side",
        F.when(blue, F.col("blue_team")).otherwise(F.col("red_team")).alias("team"),
        F.when(blue, F.col("red_team")).otherwise(F.col("blue_team")).alias("opponent"),
        "ally",
        "enemy",
        "unavailable",
        "is_pick",
        "ban_step",
        "is_red_side",
        F.when(blue, F.col("blue_pids")).otherwise(F.col("red_pids")).alias("ally_pids"),
        F.when(blue, F.col("red_pids")).otherwise(F.col("blue_pids")).alias("enemy_pids"),
        "prev_game_champs",
        "label",
    )


def dimension(spark, sf):
    p = RQ.clean_pairs(spark, sf)
    return C.candidate_dimension(
        I.vocab(spark, sf), I.position_prior(spark, sf), rates.synergy_lookup(p), rates.counter_lookup(p)
    )


def candidate_rows(spark, sf, mode):
    ids = I.vocab(spark, sf)
    p = I.player_rows(spark, sf).join(ids, "champion").withColumnRenamed("idx", "champion_id")
    k, d, a = (F.col(x) for x in ("kills", "deaths", "assists"))
    meta = p.groupBy("gameid", "champion_id").agg(
        (F.max(k) / 20).alias("meta_pick"),
        (F.max(d) / 10).alias("meta_ban"),
        (F.max(a) / 15).alias("meta_presence"),
        F.max("result").cast("double").alias("meta_wr"),
    )
    players = p.select(
        "gameid",
        "player_id",
        "champion_id",
        (k * 5.0).alias("player_mastery"),
        ((k + a) / (d + 1)).alias("player_recent_kda"),
        F.col("result").cast("double").alias("player_recent_wr"),
        k.cast("double").alias("player_recent_games"),
        (a / 2).alias("player_overall_kda"),
        ((k + 1) / 20).alias("player_overall_wr"),
        a.cast("double").alias("player_overall_games"),
    )
    from pitloom.catalog.windows import bans_with_id

    grudge = bans_with_id(spark, sf).groupBy("gameid", "team", "opponent", "champion_id").agg((F.count("*") / 5).alias("rate"))
    respect = p.select("gameid", "player_id", "champion_id", (F.least(k * 10, F.lit(100)) / 100).alias("value"))
    hot = p.select("gameid", "player_id", "champion_id", (a / 15).alias("value"))
    return C.candidate_features(
        draft_queries(spark, sf), dimension(spark, sf), meta, players, grudge, respect, hot, ids, mode
    )


PRIOR_ID = "SELECT v.idx AS cid, coalesce(pos_top, 0) AS p0, coalesce(pos_jng, 0) AS p1, coalesce(pos_mid, 0) AS p2, coalesce(pos_bot, 0) AS p3, coalesce(pos_sup, 0) AS p4 FROM vocab v LEFT JOIN prior USING (champion)"
_DEF = dict(zip(C.PLAYER, C.PLAYER_DEFAULT))
_VAL = {
    "player_mastery": "kills * 5.0",
    "player_recent_kda": "(kills + assists) / (deaths + 1)",
    "player_recent_wr": "result",
    "player_recent_games": "kills",
    "player_overall_kda": "assists / 2",
    "player_overall_wr": "(kills + 1) / 20",
    "player_overall_games": "assists",
}


def _candidate_sql(mode):
    loose = "1.2" if mode == "serve" else "1.0"

    def am(i):
        return f"least(greatest({loose} - coalesce(ao.o{i}, 0), 0), 1)"

    def em(i):
        return f"least(greatest(1.0 - coalesce(eo.o{i}, 0), 0), 1)"

    def miss(side):
        return "CASE s.pos " + " ".join(f"WHEN {i} THEN {(am if side == 'a' else em)(i)}" for i in range(5)) + " END"

    if mode == "serve":

        def fit(t):
            best = "greatest(d.p0, d.p1, d.p2, d.p3, d.p4)"
            taken = "CASE " + " ".join(f"WHEN d.p{i} = {best} THEN coalesce({t}.o{i}, 0)" for i in range(5)) + " END"
            return (
                f"CASE WHEN {best} >= 0.85 AND {taken} >= 0.85 THEN 0 ELSE greatest(0, CASE WHEN {best} >= 0.85 THEN 1.0 ELSE 1.2 END - {taken}) END"
            )

        ally_fit, enemy_fit = fit("ao"), fit("eo")
    else:
        ally_fit = " + ".join(f"d.p{i} * {am(i)}" for i in range(5))
        enemy_fit = " + ".join(f"d.p{i} * {em(i)}" for i in range(5))
    seat_cols = ", ".join(
        f"max(CASE WHEN s.mine THEN CASE WHEN s.hid = q.cid THEN CAST({v} AS DOUBLE) ELSE {_DEF[c]} END * {miss('a')} END) AS {c}"
        for c, v in _VAL.items()
    )
    own = ", ".join(
        [
            "coalesce(m.mp, 0.0) AS meta_pick",
            "coalesce(m.mb, 0.0) AS meta_ban",
            "coalesce(m.mr, 0.0) AS meta_presence",
            "coalesce(m.mw, 0.5) AS meta_wr",
            *[f"se.{c}" for c in C.PLAYER],
            *[f"d.p{i} AS pos_{p}" for i, p in enumerate(ROLES)],
            "coalesce(sy.a, 0) AS ally_synergy",
            "coalesce(sy.e, 0) AS enemy_synergy",
            "coalesce(ct.e, 0) AS enemy_counter",
            "coalesce(ct.a, 0) AS ally_counter",
            f"{ally_fit} AS ally_role_fit",
            f"{enemy_fit} AS enemy_role_fit",
            "q.is_pick",
            "se.emx AS enemy_mastery_max",
            "se.ems AS enemy_mastery_mean",
            "q.ban_step",
            "coalesce(gr.rate, 0) AS grudge",
            "se.respect",
            "se.hot_streak",
            "q.n_ally AS n_ally_picked",
            "q.is_red AS is_red_side",
            "CASE WHEN q.n_ally = 0 THEN 0.5 ELSE coalesce(ls.wr, 0.5) END AS last_ally_synergy",
            "CASE WHEN fe.cid IS NOT NULL THEN 1 ELSE 0 END AS is_fearless_banned",
            ("CASE WHEN q.cid = q.label OR (un.cid IS NULL AND fe.cid IS NULL) THEN 1 ELSE 0 END" if mode == "train" else "CASE WHEN un.cid IS NULL AND fe.cid IS NULL THEN 1 ELSE 0 END")
            + " AS mask",
        ]
    )
    cols = [*C.CANDIDATE_COLUMNS, "mask"]
    body = (
        "SELECT query_id, count(*) AS n, " + ", ".join(f"round(CAST(sum({c}) AS DOUBLE) + 1e-7, 4) AS {c}" for c in cols) + f" FROM (SELECT q.gameid AS query_id, {own} FROM qc q "
        "JOIN pid d ON d.cid = q.cid LEFT JOIN occ ao ON ao.gameid = q.gameid AND ao.mine LEFT JOIN occ eo ON eo.gameid = q.gameid AND NOT eo.mine "
        "LEFT JOIN mt m ON m.gameid = q.game AND m.cid = q.cid JOIN se ON se.gameid = q.gameid AND se.cid = q.cid "
        "LEFT JOIN sy ON sy.gameid = q.gameid AND sy.cid = q.cid LEFT JOIN ct ON ct.gameid = q.gameid AND ct.cid = q.cid "
        "LEFT JOIN gr ON gr.gameid = q.game AND gr.side = q.side AND gr.cid = q.cid LEFT JOIN la ON la.gameid = q.gameid LEFT JOIN s2 ls ON ls.x = q.cid AND ls.y = la.c "
        "LEFT JOIN fe ON fe.gameid = q.game AND fe.cid = q.cid LEFT JOIN un ON un.gameid = q.gameid AND un.cid = q.cid) GROUP BY 1"
    )
    return with_inputs(
        body,
        "player_rows",
        "ban_rows",
        "vocab",
        "prior",
        d0=RS.DRAFT_SQL,
        l=RS.LONG_SQL.replace("FROM d LEFT", "FROM d0 d LEFT"),
        qs=(
            "SELECT t.gameid * 20 + t.step AS gameid, t.gameid AS game, t.step, t.side, t.champion_id AS label, CASE WHEN t.action = 'pick' THEN 1 ELSE 0 END AS is_pick, CASE WHEN t.side = 'red' THEN 1 ELSE 0 END AS is_red, "
            "count(CASE WHEN h.action = 'ban' AND h.side = t.side THEN 1 END) + CASE WHEN t.action = 'ban' THEN 1 ELSE 0 END AS ban_step, "
            "count(CASE WHEN h.action = 'pick' AND h.side = t.side AND h.champion_id >= 7 THEN 1 END) AS n_ally "
            "FROM l t LEFT JOIN l h ON h.gameid = t.gameid AND h.step < t.step GROUP BY 1, 2, 3, 4, 5, t.action"
        ),
        qc="SELECT qs.*, v.idx AS cid FROM qs, vocab v",
        pid=PRIOR_ID,
        pk="SELECT q.gameid, h.champion_id, h.step, h.side = q.side AS mine FROM qs q JOIN l h ON h.gameid = q.game AND h.step < q.step AND h.action = 'pick' AND h.champion_id >= 7",
        occ="SELECT gameid, mine, " + ", ".join(f"sum(p{i}) AS o{i}" for i in range(5)) + " FROM pk JOIN pid ON pid.cid = pk.champion_id GROUP BY 1, 2",
        seats=(
            "SELECT p.gameid, p.side, CASE p.position WHEN 'top' THEN 0 WHEN 'jng' THEN 1 WHEN 'mid' THEN 2 WHEN 'bot' THEN 3 ELSE 4 END AS pos, v.idx AS hid, kills, deaths, assists, result "
            "FROM player_rows p LEFT JOIN vocab v USING (champion)"
        ),
        mt="SELECT gameid, hid AS cid, max(kills) / 20 AS mp, max(deaths) / 10 AS mb, max(assists) / 15 AS mr, CAST(max(result) AS DOUBLE) AS mw FROM seats WHERE hid IS NOT NULL GROUP BY 1, 2",
        se=(
            f"SELECT q.gameid, q.cid, {seat_cols}, max(CASE WHEN NOT s.mine THEN CASE WHEN s.hid = q.cid THEN kills * 5.0 ELSE 0 END * {miss('e')} END) AS emx, "
            f"sum(CASE WHEN NOT s.mine THEN CASE WHEN s.hid = q.cid THEN kills * 5.0 ELSE 0 END * {miss('e')} END) / 5 AS ems, "
            "max(CASE WHEN NOT s.mine AND s.hid = q.cid THEN least(kills * 10, 100) / 100 ELSE 0 END) AS respect, max(CASE WHEN NOT s.mine AND s.hid = q.cid THEN assists / 15 ELSE 0 END) AS hot_streak "
            "FROM qc q JOIN (SELECT seats.* EXCLUDE (gameid), qs.gameid, seats.side = qs.side AS mine FROM seats JOIN qs ON qs.game = seats.gameid) s ON s.gameid = q.gameid "
            "LEFT JOIN occ ao ON ao.gameid = q.gameid AND ao.mine LEFT JOIN occ eo ON eo.gameid = q.gameid AND NOT eo.mine GROUP BY 1, 2"
        ),
        syn=RQ._synergy_sql(False),
        s1="SELECT a.idx AS x, b.idx AS y, win_rate AS wr FROM syn JOIN vocab a ON a.champion = champion_a JOIN vocab b ON b.champion = champion_b",
        s2="SELECT x, y, wr FROM s1 UNION SELECT y, x, wr FROM s1",
        cn=RQ._counter_sql(False),
        c2="SELECT a.idx AS x, b.idx AS y, win_rate AS wr FROM cn JOIN vocab a ON a.champion = cn.champion JOIN vocab b ON b.champion = opponent_name",
        sy=(
            "SELECT q.gameid, q.cid, max(CASE WHEN k.mine THEN coalesce(s.wr, 0.5) END) AS a, max(CASE WHEN NOT k.mine THEN coalesce(s.wr, 0.5) END) AS e "
            "FROM qc q JOIN pk k ON k.gameid = q.gameid LEFT JOIN s2 s ON s.x = q.cid AND s.y = k.champion_id GROUP BY 1, 2"
        ),
        ct=(
            "SELECT q.gameid, q.cid, max(CASE WHEN k.mine THEN 1 - coalesce(s.wr, 0.5) END) AS a, max(CASE WHEN NOT k.mine THEN 1 - coalesce(s.wr, 0.5) END) AS e "
            "FROM qc q JOIN pk k ON k.gameid = q.gameid LEFT JOIN c2 s ON s.x = q.cid AND s.y = k.champion_id GROUP BY 1, 2"
        ),
        gr="SELECT b.gameid, b.side, v.idx AS cid, count(*) / 5 AS rate FROM ban_rows b JOIN vocab v USING (champion) GROUP BY 1, 2, 3",
        la="SELECT gameid, arg_max(champion_id, step) AS c FROM pk WHERE mine GROUP BY 1",
        fe="SELECT DISTINCT g.gameid, v.idx AS cid FROM games g, unnest(string_split(g.prev_game_champs, '|')) AS t(x) JOIN vocab v ON v.champion = trim(x)",
        un="SELECT DISTINCT q.gameid, h.champion_id AS cid FROM qs q JOIN l h ON h.gameid = q.game AND h.step < q.step WHERE h.champion_id >= 7",
    )


def _candidate_query(spark, sf, mode):
    rows = candidate_rows(spark, sf, mode)
    cols = [*C.CANDIDATE_COLUMNS, "mask"]
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), *[r(F.sum(F.col(c).cast("double")) + 1e-7, 4).alias(c) for c in cols])


@query("candidate_features_train", _candidate_sql("train"))
def candidate_features_train(spark, sf):
    return _candidate_query(spark, sf, "train")


@query("candidate_features_serve", _candidate_sql("serve"))
def candidate_features_serve(spark, sf):
    return _candidate_query(spark, sf, "serve")


_STY = ["team_avg_ckpm", "team_avg_golddiffat15", "team_avg_gamelength", "team_firstdragon_rate", "team_firsttower_rate"]
_STYX = ["ckpm", "coalesce(golddiffat15, 0)", "gamelength", "CAST(firstdragon AS DOUBLE)", "CAST(firsttower AS DOUBLE)"]


@query(
    "context_features",
    with_inputs(
        "SELECT g.gameid, "
        + ", ".join(f"CASE WHEN league = '{x}' THEN 1.0 ELSE 0.0 END::DOUBLE AS context_{i}" for i, x in enumerate(("LPL", "LCK", "LEC")))
        + ", "
        + ", ".join(f"round({s}.x{i}, 6) AS context_{3 + j * 5 + i}" for j, s in enumerate(("b", "r")) for i in range(5))
        + ", coalesce(playoffs, 0)::DOUBLE AS context_13, coalesce(first_pick_map_side, 1)::DOUBLE AS context_14, "
        + ", ".join(f"CASE WHEN game_num = {i} THEN 1.0 ELSE 0.0 END::DOUBLE AS context_{14 + i}" for i in range(1, 6))
        + " FROM games g JOIN t b ON b.gameid = g.gameid AND b.team = g.blue_team JOIN t r ON r.gameid = g.gameid AND r.team = g.red_team",
        "team_rows",
        t="SELECT gameid, team, " + ", ".join(f"{x} AS x{i}" for i, x in enumerate(_STYX)) + " FROM team_rows",
    ),
)
def context_features(spark, sf):
    from pitloom.operators.reshape import melt_teams

    g = I.games(spark, sf)
    style = melt_teams(g).select("gameid", "team", *[F.expr(x).alias(c) for c, x in zip(_STY, _STYX)])
    out = C.context_features(g.select("gameid", "league", "playoffs", "first_pick_map_side", "game_num", "blue_team", "red_team"), style)
    return out.select("gameid", *[r(f"context_{i}").alias(f"context_{i}") for i in range(20)])


# ---- ranking ----
@query(
    "topk_recall",
    with_inputs("SELECT * FROM (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY cs_logit DESC, candidate_id) AS rank FROM scores WHERE mask = 1) WHERE rank <= 50", "scores"),
)
def topk_recall(spark, sf):
    return R.topk(I.scores(spark, sf), "query_id", "cs_logit", 50, mask="mask").select("query_id", "candidate_id", "rank")


_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {s} DESC, candidate_id)"
_RANKMAP = with_inputs(
    "SELECT query_id, candidate_id, rank, total_valid, round(1 - rank / total_valid, 6) AS rank_pct FROM ("
    f"SELECT query_id, candidate_id, {_RANK.format(s='cs_logit')} AS rank, count(*) OVER (PARTITION BY query_id) AS total_valid FROM scores)",
    "scores",
)


@query("rank_map", _RANKMAP)
def rank_map(spark, sf):
    out = R.rank_map(I.scores(spark, sf), "query_id", "cs_logit")
    return out.select("query_id", "candidate_id", "rank", "total_valid", r("rank_pct").alias("rank_pct"))


@query("rank_map_cells", _RANKMAP)
def rank_map_cells(spark, sf):
    out = R.rank_map(I.scores(spark, sf), "query_id", "cs_logit", cells=16)
    return out.select("query_id", "candidate_id", "rank", "total_valid", r("rank_pct").alias("rank_pct"))


_STATS = (
    "SELECT query_id, min(CASE WHEN mask = 1 THEN cs_logit END) AS lo, max(CASE WHEN mask = 1 THEN cs_logit END) AS hi, avg(CASE WHEN mask = 1 THEN cs_logit END) AS m, "
    "greatest(stddev_pop(CASE WHEN mask = 1 THEN cs_logit END), 1e-6) AS s, max(cs_logit) AS t1 FROM scores GROUP BY 1"
)


@query(
    "score_stats",
    with_inputs(
        "SELECT query_id, round(lo, 6) AS logit_min, round(hi, 6) AS logit_max, round(hi - lo, 6) AS logit_range, round(m, 5) AS valid_mean, round(s, 5) AS valid_std, round(t1, 6) AS top1_logit, "
        "round(m, 5) AS valid_median, round(m + 0.675 * s, 5) AS valid_q75, round(m - 0.675 * s, 5) AS valid_q25, round(1.35 * s, 5) AS valid_iqr FROM st",
        "scores",
        st=_STATS,
    ),
)
def score_stats(spark, sf):
    s = R.score_stats(I.scores(spark, sf), "query_id", "cs_logit")
    six = {"logit_min", "logit_max", "logit_range", "top1_logit"}
    return s.select("query_id", *[r(c, 6 if c in six else 5).alias(c) for c in s.columns if c != "query_id"])


# candidate columns as expressions over the score rows (tables of the ranking family)
_CF = {
    "meta_presence": "(candidate_id % 17) / 17.0e0",
    "meta_wr": "(candidate_id % 13) / 13.0e0",
    "meta_ban": "(candidate_id % 19) / 19.0e0",
    "player_mastery": "(candidate_id % 101) / 1.3e0",
    "ally_synergy": "(query_id % 7) / 7.0e0",
    "enemy_counter": "((query_id + candidate_id) % 11) / 11.0e0",
    "ally_role_fit": "(candidate_id % 5) / 5.3e0",
    "enemy_role_fit": "(candidate_id % 6) / 6.1e0",
    "enemy_mastery_max": "(query_id % 53) / 1.7e0",
    "n_ally_picked": "(query_id % 5) * 1.0",
    "last_ally_synergy": "(candidate_id % 29) / 29.0e0",
    "bp_step": "query_id % 20",
    "ban_step": "query_id % 6",
    "grudge": "(candidate_id % 3) / 3.0e0",
    "respect": "(candidate_id % 23) / 23.0e0",
    "hot_streak": "(candidate_id % 31) / 31.0e0",
}
_CFSQL = "SELECT query_id, candidate_id, cs_logit, nocs_logit, mask, label, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CF.items()) + " FROM scores"


def score_features(spark, sf):
    return I.scores(spark, sf).selectExpr(
        "query_id", "candidate_id", "cs_logit", "nocs_logit", "mask", "label", *[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _CF.items()]
    )


_P1 = "CASE WHEN bp_step < 12 THEN 1.0 ELSE 0.0 END"
_PICK = {
    "logit_diff": "cs_logit - nocs_logit",
    "p1_meta_presence": f"meta_presence * {_P1}",
    "p1_mastery": f"player_mastery * {_P1}",
    "p1_cs_logit": f"cs_logit * {_P1}",
    "p2_role_fit": f"ally_role_fit * (1 - {_P1})",
    "p2_synergy": f"ally_synergy * (1 - {_P1})",
    "p2_counter": f"enemy_counter * (1 - {_P1})",
    "p2_mastery_x_role": f"player_mastery * ally_role_fit * (1 - {_P1})",
    "perfect_fit": "ally_role_fit * ally_synergy",
    "counter_kill": "ally_role_fit * enemy_counter",
    "combo_synergy": "last_ally_synergy * CASE WHEN n_ally_picked >= 1 THEN 1 ELSE 0 END",
    "enemy_mastery_choke": "enemy_mastery_max * enemy_counter",
}


@query(
    "pick_cascade_features",
    with_inputs("SELECT query_id, candidate_id, " + ", ".join(f"round({e}, 5) + 0.0 AS {c}" for c, e in _PICK.items()) + " FROM f", "scores", f=_CFSQL),
)
def pick_cascade_features(spark, sf):
    return R.pick_features(score_features(spark, sf)).select("query_id", "candidate_id", *[(r(c, 5) + 0.0).alias(c) for c in _PICK])


_B1 = "CASE WHEN ban_step <= 3 THEN 1.0 ELSE 0.0 END"
_BAN = {
    "logit_percentile": "0.5 * (1 + tanh((cs_logit - m) / s * 0.5))",
    "logit_gap_top1": "cs_logit - t1",
    "p1_meta_ban": f"meta_ban * {_B1}",
    "p1_threat_respect": f"respect * enemy_mastery_max * {_B1}",
    "p1_threat_hot_streak": f"hot_streak * enemy_mastery_max * {_B1}",
    "p2_choke_meta": f"enemy_role_fit * meta_wr * (1 - {_B1})",
    "p2_choke_mastery": f"enemy_role_fit * enemy_mastery_max * (1 - {_B1})",
    "p2_grudge": f"grudge * (1 - {_B1})",
    "p2_enemy_mastery": f"enemy_mastery_max * (1 - {_B1})",
    "threat_meta_mastery": "meta_ban * enemy_mastery_max",
    "choke_composite": f"(enemy_role_fit * meta_wr + enemy_role_fit * enemy_mastery_max) * (1 - {_B1})",
}


@query(
    "ban_cascade_features",
    with_inputs(
        "SELECT query_id, candidate_id, " + ", ".join(f"round({e}, 5) + 0.0 AS {c}" for c, e in _BAN.items()) + " FROM f JOIN st USING (query_id)", "scores", f=_CFSQL, st=_STATS
    ),
)
def ban_cascade_features(spark, sf):
    f = score_features(spark, sf)
    st = R.score_stats(f, "query_id", "cs_logit").select("query_id", "valid_mean", "valid_std", "top1_logit")
    return R.ban_features(f.join(st, "query_id"), score="cs_logit").select("query_id", "candidate_id", *[(r(c, 5) + 0.0).alias(c) for c in _BAN])


_RN = "1 - ({k} - 1) / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1)"
_RNS = (
    f"SELECT query_id, candidate_id, label, {_RN.format(k=_RANK.format(s='cs_logit'))} AS ra, {_RN.format(k=_RANK.format(s='nocs_logit'))} AS rb FROM scores"
)


@query(
    "rank_blend",
    with_inputs("SELECT query_id, candidate_id, round(ra, 6) AS ra, round(rb, 6) AS rb, round(0.3 * ra + 0.7 * rb, 6) AS score FROM x", "scores", x=_RNS),
)
def rank_blend(spark, sf):
    s = R.rank_normalise(I.scores(spark, sf), "query_id", "cs_logit", out="ra", cells=8)
    s = R.rank_normalise(s, "query_id", "nocs_logit", out="rb")
    return s.select("query_id", "candidate_id", r("ra").alias("ra"), r("rb").alias("rb"), r(R.blend("ra", "rb", 0.3)).alias("score"))


_GRID = [i / 20 for i in range(0, 21)]


@query(
    "alpha_search",
    with_inputs(
        "SELECT alpha, hit_rate, alpha = (SELECT min(alpha) FROM h WHERE hit_rate = (SELECT max(hit_rate) FROM h)) AS best FROM h",
        "scores",
        x=_RNS,
        p="SELECT query_id, arg_min(ra, candidate_id) AS pa, arg_min(rb, candidate_id) AS pb, min(candidate_id) AS pc FROM x WHERE label = 1 GROUP BY 1",
        a="SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in _GRID) + "]) AS alpha",
        n=(
            "SELECT a.alpha, x.query_id, count(CASE WHEN round(alpha * ra + (1 - alpha) * rb, 9) > round(alpha * pa + (1 - alpha) * pb, 9) OR "
            "(round(alpha * ra + (1 - alpha) * rb, 9) = round(alpha * pa + (1 - alpha) * pb, 9) AND candidate_id < pc) THEN 1 END) AS better FROM x JOIN p USING (query_id), a GROUP BY 1, 2"
        ),
        h="SELECT alpha, round(avg(CASE WHEN better < 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM n GROUP BY 1",
    ),
)
def alpha_search(spark, sf):
    s = R.rank_normalise(R.rank_normalise(I.scores(spark, sf), "query_id", "cs_logit", out="ra"), "query_id", "nocs_logit", out="rb")
    return R.tune_alpha(s, "query_id", "ra", "rb", "label", _GRID).withColumn("hit_rate", r("hit_rate"))


@query(
    "ensemble_mean",
    with_inputs("SELECT segment, row_id % 100 AS row_id, round(avg(p), 6) AS p, count(*) AS n_models FROM preds GROUP BY 1, 2", "preds"),
)
def ensemble_mean(spark, sf):
    p = I.preds(spark, sf).withColumn("row_id", F.col("row_id") % 100)
    return R.ensemble_mean(p, ["segment", "row_id"], "p").withColumn("p", r("p"))


# lineups for the position filters: ally = first three known picks of the blue side
def conflict_rows(spark, sf):
    """The queries, and the candidates of each of them."""
    return draft_queries(spark, sf).select("query_id", "ally", "enemy"), I.vocab(spark, sf).select(F.col("idx").alias("candidate_id"))


def priors(spark, sf):
    # sharpened so that hard positions exist
    p = dimension(spark, sf).select("candidate_id", "pos")
    sharp = F.transform("pos", lambda x, i: F.when(F.pmod(F.col("candidate_id"), F.lit(3)) == 0, F.when(i == F.col("candidate_id") % 5, 0.9).otherwise(0.025)).otherwise(x))
    return p.select("candidate_id", sharp.alias("pos"))


SHARP = "SELECT cid, " + ", ".join(f"CASE WHEN cid % 3 = 0 THEN CASE WHEN cid % 5 = {i} THEN 0.9 ELSE 0.025 END ELSE p{i} END AS p{i}" for i in range(5)) + " FROM pid"
_BEST = "greatest(p0, p1, p2, p3, p4)"
_ATX = f"CASE WHEN p0 = {_BEST} THEN 1 WHEN p1 = {_BEST} THEN 2 WHEN p2 = {_BEST} THEN 3 WHEN p3 = {_BEST} THEN 4 ELSE 5 END"
_CONF = dict(
    d0=RS.DRAFT_SQL,
    l=RS.LONG_SQL.replace("FROM d LEFT", "FROM d0 d LEFT"),
    qs="SELECT gameid * 20 + step AS gameid, gameid AS game, step, side FROM l",
    pid=PRIOR_ID,
    sh=SHARP,
    b=f"SELECT *, {_BEST} AS best, {_ATX} AS atp FROM sh",
    pk="SELECT q.gameid, h.champion_id AS c, h.side = q.side AS mine FROM qs q JOIN l h ON h.gameid = q.game AND h.step < q.step AND h.action = 'pick' AND h.champion_id >= 7",
    qc="SELECT qs.gameid, b.* FROM qs, b",
)


@query(
    "ban_conflict_filter",
    with_inputs(
        "SELECT gameid AS query_id, count(*) AS n, CAST(sum(cid) AS BIGINT) AS ids FROM qc q WHERE NOT (q.best >= 0.85 AND EXISTS (SELECT 1 FROM pk JOIN b ON b.cid = pk.c WHERE pk.gameid = q.gameid AND NOT pk.mine AND b.best >= 0.85 AND b.atp = q.atp)) GROUP BY 1",
        "games",
        "vocab",
        "prior",
        **_CONF,
    ),
)
def ban_conflict_filter(spark, sf):
    q, ids = conflict_rows(spark, sf)
    kept = R.filter_ban_conflicts(q, priors(spark, sf), candidates=ids)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"))


_M = "CASE WHEN mm = 0 THEN 31 ELSE mm END"
_PICK_SQL = with_inputs(
    "SELECT gameid AS query_id, count(*) AS n, CAST(sum(cid) AS BIGINT) AS ids FROM qc q LEFT JOIN ag USING (gameid) LEFT JOIN stuck USING (gameid, cid) WHERE NOT ("
    "coalesce(q.best >= 0.85 AND ag.hard[q.atp] > 0, false) OR (coalesce(ag.n, 0) > 0 AND (ag.same[q.atp] >= 2 OR (q.best >= 0.4 AND ag.held[q.atp] + q.best > 2.0) OR stuck.gameid IS NOT NULL))) GROUP BY 1",
    "games",
    "vocab",
    "prior",
    **_CONF,
    bm="SELECT *, " + " + ".join(f"CASE WHEN p{i} >= 0.15 THEN {1 << i} ELSE 0 END" for i in range(5)) + " AS mm FROM b",
    al=f"SELECT pk.gameid, bm.*, {_M} AS m FROM pk JOIN bm ON bm.cid = pk.c WHERE pk.mine",
    ag=(
        "SELECT gameid, count(*) AS n, ["
        + ", ".join(f"count(CASE WHEN best >= 0.85 AND atp = {i} THEN 1 END)" for i in range(1, 6))
        + "] AS hard, ["
        + ", ".join(f"count(CASE WHEN atp = {i} THEN 1 END)" for i in range(1, 6))
        + "] AS same, ["
        + ", ".join(f"sum(p{i})" for i in range(5))
        + "] AS held FROM al GROUP BY 1"
    ),
    # no lineup if more champions live inside a set of roles than the set has roles
    ar="SELECT gameid, r, count(CASE WHEN m & (31 - r) = 0 THEN 1 END) AS inside FROM al, (SELECT CAST(unnest(range(1, 32)) AS INT) AS r) GROUP BY 1, 2",
    stuck=(
        "SELECT DISTINCT ar.gameid, c.cid FROM ar JOIN qs ON qs.gameid = ar.gameid, "
        f"(SELECT cid, {_M} AS m FROM bm) c WHERE ar.inside + CASE WHEN c.m & (31 - ar.r) = 0 THEN 1 ELSE 0 END > bit_count(ar.r)"
    ),
)


@query("pick_conflict_filter", _PICK_SQL)
def pick_conflict_filter(spark, sf):
    q, ids = conflict_rows(spark, sf)
    kept = R.filter_pick_conflicts(q, priors(spark, sf), candidates=ids)
    return kept.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("candidate_id").alias("ids"))


@query(
    "enrich_results",
    with_inputs(
        "SELECT gameid AS query_id, count(*) AS n, count(CASE WHEN conflict THEN 1 END) AS n_conflict, count(CASE WHEN prob >= 0.85 THEN 1 END) AS n_fit, round(sum(prob), 4) AS prob_sum, "
        "count(CASE WHEN (cid % 13) / 13.0 > 0.55 THEN 1 END) AS n_strong FROM ("
        "SELECT q.gameid, q.cid, CASE WHEN h.taken[q.atp] THEN coalesce(alt, best) ELSE best END AS prob, h.taken[q.atp] AND alt IS NULL AS conflict FROM ("
        "SELECT q.*, greatest(" + ", ".join(f"CASE WHEN NOT t.taken[{i + 1}] AND p{i} > 0.15 THEN p{i} END" for i in range(5)) + ") AS alt FROM qc q JOIN tk t ON t.gameid = q.gameid) q JOIN tk h ON h.gameid = q.gameid) GROUP BY 1",
        "games",
        "vocab",
        "prior",
        **_CONF,
        tk=(
            "SELECT qs.gameid, [" + ", ".join(f"coalesce(bool_or(pk.mine AND b.best >= 0.85 AND b.atp = {i}), false)" for i in range(1, 6)) + "] AS taken "
            "FROM qs LEFT JOIN pk ON pk.gameid = qs.gameid LEFT JOIN b ON b.cid = pk.c GROUP BY 1"
        ),
    ),
)
def enrich_results(spark, sf):
    q, ids = conflict_rows(spark, sf)
    facts = {"meta_wr": (F.col("candidate_id") % 13) / 13.0, "meta_presence": F.lit(0.1), "meta_ban": F.lit(0.1)}
    e = R.enrich(q, priors(spark, sf), candidates=ids, facts=facts)
    return e.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.count_if("position_conflict").alias("n_conflict"),
        F.count_if(F.array_contains("reasons", "position_fit")).alias("n_fit"),
        r(F.sum("assigned_prob"), 4).alias("prob_sum"),
        F.count_if(F.array_contains("reasons", "strong_patch")).alias("n_strong"),
    )


@query(
    "catalogue",
    with_inputs(
        "SELECT v.champion, v.idx, coalesce(s.presence, 0.0) AS presence, t.engage FROM vocab v LEFT JOIN (SELECT champion, CAST(count(*) AS DOUBLE) AS presence FROM player_rows GROUP BY 1) s USING (champion) LEFT JOIN tags t USING (champion)",
        "vocab",
        "player_rows",
        "tags",
    ),
)
def catalogue(spark, sf):
    s = I.player_rows(spark, sf).groupBy("champion").agg(F.count("*").cast("double").alias("presence"))
    return R.catalogue(I.vocab(spark, sf), s, I.tags(spark, sf)).select("champion", "idx", "presence", "engage")


@query(
    "renumber_top",
    with_inputs(f"SELECT * FROM (SELECT query_id, candidate_id, {_RANK.format(s='nocs_logit')} AS rank FROM scores WHERE mask = 1) WHERE rank <= 5", "scores"),
)
def renumber_top(spark, sf):
    return R.renumber(I.scores(spark, sf).filter("mask = 1"), "query_id", "nocs_logit", 5).select("query_id", "candidate_id", "rank")


# ---- rules ----
_MAST = "10 * (0.4 * least(games / 20, 1.0) + 0.3 * win_rate + 0.3 * least(kda / 5, 1.0))"


@query("static_mastery", with_inputs(f"SELECT player_id, champion, round({_MAST}, 6) AS mastery FROM career", "career"))
def static_mastery(spark, sf):
    c = I.career(spark, sf)
    return c.select("player_id", "champion", r(rules.static_mastery("games", "win_rate", "kda")).alias("mastery"))


def rule_inputs(spark, sf):
    d = draft_queries(spark, sf).withColumn("position", (F.col("query_id") % 5 + 1).cast("int"))
    meta = dimension(spark, sf).select("candidate_id", "pos").withColumns(
        {"presence": (F.col("candidate_id") * 7 % 23) / 40.0, "meta_wr": (F.col("candidate_id") * 5 % 19) / 19.0}
    )
    c = I.career(spark, sf).join(I.vocab(spark, sf), "champion")
    m = c.select("player_id", F.col("idx").alias("candidate_id"), F.round(rules.static_mastery("games", "win_rate", "kda"), 6).alias("mastery"))
    return d, meta, m


_RULE = dict(
    d0=RS.DRAFT_SQL,
    l=RS.LONG_SQL.replace("FROM d LEFT", "FROM d0 d LEFT"),
    qs="SELECT gameid * 20 + step AS gameid, gameid AS game, step, side FROM l",
    pid=PRIOR_ID,
    mt="SELECT cid, (cid * 7 % 23) / 40e0 AS presence, (cid * 5 % 19) / 19e0 AS wr, p0, p1, p2, p3, p4 FROM pid",
    un="SELECT DISTINCT q.gameid, h.champion_id AS cid FROM qs q JOIN l h ON h.gameid = q.game AND h.step < q.step WHERE h.champion_id >= 7",
    ms=f"SELECT c.player_id, v.idx AS cid, round({_MAST}, 6) AS m FROM career c JOIN vocab v USING (champion)",
    qc="SELECT qs.*, mt.* FROM qs, mt WHERE NOT EXISTS (SELECT 1 FROM un WHERE un.gameid = qs.gameid AND un.cid = mt.cid)",
)
_POSOK = "CASE gameid % 5 " + " ".join(f"WHEN {i} THEN p{i}" for i in range(5)) + " END >= 0.05"


def _lists(rows):
    """One row per query: the candidates in order of rank, and the best score."""
    return f"SELECT query_id, string_agg(candidate_id, ',' ORDER BY rank) AS candidates, max(score) AS best FROM ({rows}) GROUP BY 1"


def in_order(listed):
    """`_lists` of queries that hold their candidates as the array `top`."""
    ids = F.col("top.candidate_id").cast("array<string>")
    return listed.select("query_id", F.array_join(ids, ",").alias("candidates"), F.array_max(F.col("top.score")).alias("best"))


# a query's rows lie with its game, so that naming the game spares a shuffle of all queries
_OF_GAME = ["gameid", "query_id"]


def _top(score, k, frm, extra=""):
    return (
        f"SELECT query_id, candidate_id, score, rank FROM (SELECT gameid AS query_id, cid AS candidate_id, score, row_number() OVER (PARTITION BY gameid ORDER BY score DESC, cid) AS rank FROM (SELECT gameid, cid, {score} AS score {frm}) {extra}) WHERE rank <= {k}"
    )


@query(
    "rule_pick",
    with_inputs(
        _lists(_top(
            "round(0.6 * presence + 0.4 * CASE WHEN coalesce(m, 0) > 0 THEN m ELSE least(presence * 20, 5.0) END / 10, 4)",
            50,
            f"FROM qc LEFT JOIN bm USING (gameid, cid) WHERE presence >= 0.05 AND {_POSOK}",
        )),
        "player_rows",
        "vocab",
        "prior",
        "career",
        **_RULE,
        bm="SELECT qs.gameid, ms.cid, max(ms.m) AS m FROM qs JOIN player_rows p ON p.gameid = qs.game AND p.side = qs.side JOIN ms ON ms.player_id = p.player_id GROUP BY 1, 2",
    ),
)
def rule_pick(spark, sf):
    q, meta, m = rule_inputs(spark, sf)
    q = q.select(*_OF_GAME, "side", "position", "ally_pids", "unavailable")
    return in_order(rules.rule_pick(q, meta, m, q=_OF_GAME, lineup=["gameid", "side"], lists=True))


@query(
    "rule_pick_general",
    with_inputs(_lists(_top("round(presence, 4)", 50, f"FROM qc WHERE presence >= 0.05 AND {_POSOK}")), "games", "vocab", "prior", "career", **_RULE),
)
def rule_pick_general(spark, sf):
    q, meta, _ = rule_inputs(spark, sf)
    return in_order(rules.rule_pick_general(q.select(*_OF_GAME, "position", "unavailable"), meta, q=_OF_GAME, lists=True))


@query(
    "rule_ban",
    with_inputs(
        _lists("SELECT query_id, candidate_id, score, rank FROM (SELECT gameid AS query_id, cid AS candidate_id, score, row_number() OVER (PARTITION BY gameid ORDER BY score DESC, cid) AS rank FROM ("
        "SELECT q.gameid, q.cid, round(0.5 * ms.m / 10 + 0.5 * q.wr, 4) AS score, q.wr >= 0.5 AS good, bool_or(q.wr >= 0.5) OVER (PARTITION BY q.gameid) AS any_good "
        "FROM qc q JOIN tp ON tp.gameid = q.gameid JOIN ms ON ms.player_id = tp.player_id AND ms.cid = q.cid) WHERE good OR NOT any_good) WHERE rank <= 3 UNION ALL "
        + _top("round(0.6 * presence + 0.4 * wr, 4)", 50, "FROM qc WHERE gameid NOT IN (SELECT tp.gameid FROM tp JOIN ms ON ms.player_id = tp.player_id)")),
        "player_rows",
        "vocab",
        "prior",
        "career",
        **_RULE,
        tp=(
            "SELECT qs.gameid, p.player_id FROM qs JOIN player_rows p ON p.gameid = qs.game AND p.side <> qs.side AND p.position = "
            "CASE qs.gameid % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'jng' WHEN 2 THEN 'mid' WHEN 3 THEN 'bot' ELSE 'sup' END"
        ),
    ),
)
def rule_ban(spark, sf):
    q, meta, m = rule_inputs(spark, sf)
    q = q.select(*_OF_GAME, F.element_at("enemy_pids", F.col("position")).alias("player_id"), "unavailable")
    return in_order(rules.rule_ban(q, meta, m, q=_OF_GAME, lists=True))


@query(
    "rule_ban_global",
    with_inputs(_lists(_top("round(0.6 * presence + 0.4 * wr, 4)", 50, "FROM qc")), "games", "vocab", "prior", "career", **_RULE),
)
def rule_ban_global(spark, sf):
    q, meta, _ = rule_inputs(spark, sf)
    return in_order(rules.rule_ban_global(q.select(*_OF_GAME, "unavailable"), meta, q=_OF_GAME, lists=True))


@query(
    "rule_win_prob",
    with_inputs(
        "SELECT gameid, round(greatest(least(b / (b + r), 0.75), 0.25) + 1e-9, 6) AS blue_prob FROM (SELECT p.gameid, avg(CASE WHEN side = 'blue' THEN coalesce(w, 0.5) END) AS b, avg(CASE WHEN side = 'red' THEN coalesce(w, 0.5) END) AS r "
        "FROM player_rows p LEFT JOIN (SELECT champion, (CAST(substr(champion, 2) AS BIGINT) * 7 % 23) / 23.0 AS w FROM vocab) m USING (champion) GROUP BY 1)",
        "player_rows",
        "vocab",
    ),
)
def rule_win_prob(spark, sf):
    m = I.vocab(spark, sf).select("champion", (F.substring("champion", 2, 9).cast("long") * 7 % 23 / 23.0).alias("meta_wr"))
    p = I.player_rows(spark, sf).select("gameid", "side", "champion")
    return rules.rule_win_prob(p, m).select("gameid", r(F.col("blue_prob") + 1e-9).alias("blue_prob"))


@query(
    "collapse_flag",
    with_inputs(
        "SELECT query_id, count(*) >= 10 AND max(s) - min(s) < 0.5 AS collapsed FROM (SELECT query_id, nocs_logit AS s, row_number() OVER (PARTITION BY query_id ORDER BY nocs_logit DESC, candidate_id) AS rn FROM scores) WHERE rn <= 10 GROUP BY 1",
        "scores",
    ),
)
def collapse_flag(spark, sf):
    return rules.collapse_flag(I.scores(spark, sf), "query_id", "nocs_logit")


@query(
    "cold_start",
    "SELECT round(avg(CASE WHEN p > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS active_share, avg(CASE WHEN p > 0.01 THEN 1.0 ELSE 0.0 END) < 0.3 AS cold FROM (SELECT l_partkey, count(*) / 2000.0 AS p FROM lineitem GROUP BY 1)",
)
def cold_start(spark, sf):
    m = I.table(spark, sf, "lineitem").groupBy("l_partkey").agg((F.count("*") / 2000).alias("presence"))
    return rules.cold_start(m).withColumn("active_share", r("active_share"))


_METRIC = "SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'pick_at_10' WHEN 1 THEN 'ban_at_10' ELSE 'auc' END AS metric, ((event_id * 37) % 100) / 101e0 AS value FROM events"


@query(
    "rolling_degraded",
    f"SELECT event_id, metric, round(m, 6) AS rolling_mean, n AS rolling_n, n >= 15 AND m < CASE metric WHEN 'pick_at_10' THEN 0.55 WHEN 'ban_at_10' THEN 0.52 ELSE 0.53 END AS degraded FROM ("
    f"SELECT *, avg(value) OVER w AS m, count(*) OVER w AS n FROM ({_METRIC}) WINDOW w AS (PARTITION BY metric ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))",
)
def rolling_degraded(spark, sf):
    e = I.table(spark, sf, "events").selectExpr(
        "event_id", "ts", "CASE user_id % 3 WHEN 0 THEN 'pick_at_10' WHEN 1 THEN 'ban_at_10' ELSE 'auc' END AS metric", "((event_id * 37) % 100) / 101e0 AS value"
    )
    out = rules.rolling_degraded(e, ["ts", "event_id"], F.unix_date(F.to_date("ts")))
    return out.select("event_id", "metric", r("rolling_mean").alias("rolling_mean"), "rolling_n", "degraded")


@query(
    "route_queries",
    with_inputs(
        "SELECT path, count(*) AS n FROM (SELECT CASE WHEN gameid % 97 = 0 THEN 'cold_start' WHEN gameid % 89 = 0 THEN 'rolling_degraded' WHEN gameid % 13 = 0 THEN 'logit_collapse' "
        "WHEN league = 'LEC' AND (gameid % 100) / 100.0 < 0.55 THEN 'low_confidence' ELSE 'model' END AS path FROM games) GROUP BY 1",
        "games",
    ),
)
def route_queries(spark, sf):
    g = I.games(spark, sf).selectExpr(
        "gameid", "league", "gameid % 97 = 0 AS cold", "gameid % 89 = 0 AS degraded", "gameid % 13 = 0 AS collapsed", "(gameid % 100) / 100.0 AS confidence"
    )
    return rules.route(g).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "extra_context",
    with_inputs(
        "SELECT gameid, round((coalesce(try_cast(patch AS DOUBLE), 14.0) - 14) / 2, 6) AS context_20, CAST(game_num AS DOUBLE) AS context_21, "
        "round((day / 365.25 - 53) / 3, 6) AS context_22, round(ln(1 + gameid % 500) / 10, 6) AS context_23 FROM games",
        "games",
    ),
)
def extra_context(spark, sf):
    g = I.games(spark, sf)
    patch = F.coalesce(F.col("patch").try_cast("double"), F.lit(14.0))
    cols = C.extra_context(patch, F.col("game_num"), F.col("day") / 365.25 + 1970, F.col("gameid") % 500)
    return g.select("gameid", *cols).select("gameid", *[r(c).alias(c) for c in ("context_20", "context_21", "context_22", "context_23")])
