"""Queries for derived features and training-frame preparation (families G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import inputs as I
from pitloom.catalog import query
from pitloom.catalog.inputs import with_inputs
from pitloom.operators import derive as D
from pitloom.operators import prep
from pitloom.operators.reshape import ROLES, SIDES


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# base feature columns of a game, as plain expressions both engines read
BASE = {}
for _s in SIDES:
    for _p in ROLES:
        for _i, _c in enumerate([*D.PLAYER_COLS, *D.META_COLS, "meta_presence_pit"]):
            BASE[f"{_s}_{_p}_{_c}"] = f"CAST({_s}_{_p}_kills * {_i + 1} + {_s}_{_p}_assists * {(_i * 3) % 4} + {_s}_{_p}_deaths AS DOUBLE) / 7.3"
    for _i, _c in enumerate(D.TEAM_COLS):
        BASE[f"{_s}_{_c}"] = f"CAST({_s}_top_kills * {_i + 2} + {_s}_sup_assists + game_num AS DOUBLE) / 11.7"
_CH = [f"{s}_{p}_champion" for s in SIDES for p in ROLES]
WIDE_SQL = "SELECT gameid, result, " + ", ".join(_CH) + ", " + ", ".join(f"{e} AS {c}" for c, e in BASE.items()) + " FROM games"


def wide(spark, sf):
    return I.games(spark, sf).selectExpr("gameid", "result", *_CH, *[f"{e} AS {c}" for c, e in BASE.items()])


def _register(name, fn, cols, extra=(), pre=()):
    """One query per family; `cols` maps output column -> SQL over the wide rows."""
    body = ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in cols.items())

    @query(name, with_inputs(f"SELECT gameid, {body} FROM w", "games", *extra, w=WIDE_SQL))
    def run(spark, sf):
        df = wide(spark, sf)
        for step in pre:
            df = step(df)
        return fn(df).select("gameid", *[(r(c) + 0.0).alias(c) for c in cols])

    return run


_PC = [*D.PLAYER_COLS, *D.META_COLS]
_register(
    "derive_position_diffs", D.position_diffs, {f"diff_{p}_{c}": f"blue_{p}_{c} - red_{p}_{c}" for p in ROLES for c in _PC}
)


def _mean(s, c):
    return "(" + " + ".join(f"{s}_{p}_{c}" for p in ROLES) + ") / 5"


def _std(s, c):
    return "sqrt((" + " + ".join(f"pow({s}_{p}_{c} - {_mean(s, c)}, 2)" for p in ROLES) + ") / 4)"


def _args(s, c):
    return ", ".join(f"{s}_{p}_{c}" for p in ROLES)


_agg = {}
for _s in SIDES:
    for _c in D.PLAYER_COLS:
        _agg[f"{_s}_team_avg_{_c}"] = _mean(_s, _c)
        _agg[f"{_s}_team_max_{_c}"] = f"greatest({_args(_s, _c)})"
        _agg[f"{_s}_team_std_{_c}"] = _std(_s, _c)
    for _c in D.META_COLS:
        _agg[f"{_s}_team_avg_{_c}"] = _mean(_s, _c)
for _c in _PC:
    _agg[f"diff_team_avg_{_c}"] = f"{_mean('blue', _c)} - {_mean('red', _c)}"
_register("derive_side_aggregates", D.side_aggregates, _agg)
_register("derive_profile_diffs", D.profile_diffs, {f"diff_{c}": f"blue_{c} - red_{c}" for c in D.TEAM_COLS})

_int = {}


def _ix(s, p):
    g = f"{s}_{p}_"
    return {
        "champ_wr_delta": f"({g}player_recent_wr_90d - {g}player_overall_recent_wr)",
        "champ_kda_delta": f"({g}player_recent_kda_90d - {g}player_overall_recent_kda)",
        "mastery_x_presence": f"({g}mastery_score * {g}meta_presence_pit)",
        "mastery_x_wr": f"({g}mastery_score * {g}meta_win_rate_pit)",
    }


for _p in ROLES:
    for _s in SIDES:
        for _c, _e in _ix(_s, _p).items():
            _int[f"{_s}_{_p}_{_c}"] = _e
    for _c in ("champ_wr_delta", "champ_kda_delta", "mastery_x_wr"):
        _int[f"diff_{_p}_{_c}"] = f"{_ix('blue', _p)[_c]} - {_ix('red', _p)[_c]}"
    _dm = f"(blue_{_p}_mastery_score - red_{_p}_mastery_score)"
    _int[f"diff_{_p}_mastery_x_meta_wr"] = f"{_dm} * (blue_{_p}_meta_win_rate_pit - red_{_p}_meta_win_rate_pit)"
    _int[f"diff_{_p}_mastery_x_player_wr"] = f"{_dm} * (blue_{_p}_player_overall_recent_wr - red_{_p}_player_overall_recent_wr)"
_register("derive_interactions", D.interactions, _int, pre=[D.position_diffs])

_bal, _wr = {}, "player_overall_recent_wr"
for _s in SIDES:
    _bal[f"{_s}_team_wr_max_gap"] = f"(greatest({_args(_s, _wr)}) - least({_args(_s, _wr)}))"
    _bal[f"{_s}_team_wr_balance"] = _std(_s, _wr)
    _bal[f"{_s}_team_wr_x_roster_wr"] = f"({_s}_team_recent_wr * {_mean(_s, _wr)})"
for _c in ("team_wr_max_gap", "team_wr_balance", "team_wr_x_roster_wr"):
    _bal[f"diff_{_c}"] = f"{_bal['blue_' + _c]} - {_bal['red_' + _c]}"
_register("derive_balance", D.balance, _bal, pre=[D.side_aggregates])

# composition: the tag table joined five times per side in the reference SQL
_TAG_JOINS = " ".join(f"LEFT JOIN tags {s}_{p} ON {s}_{p}.champion = w.{s}_{p}_champion" for s in SIDES for p in ROLES)


def _tag(s, t):
    return "(" + " + ".join(f"coalesce({s}_{p}.{t}, {D.TAG_DEFAULTS[t]})" for p in ROLES) + ")"


def _comp(s):
    t = {x: _tag(s, x) for x in D.TAGS}
    out = {f"comp_{x}_sum": t[x] for x in D.TAGS}
    out.update({f"comp_{x}_avg": f"{t[x]} / 5.0" for x in D.TAGS})
    out["comp_early_power"] = f"({t['linestrength']} + {t['burst']} * 0.5 + {t['engage']} * 0.3)"
    out["comp_late_power"] = f"({t['tank']} + {t['peel']} * 0.5)"
    out["comp_teamfight_score"] = f"({t['engage']} + {t['hardcc']} * 0.8 + {t['tank']} * 0.3)"
    out["comp_aggression_index"] = f"(CAST({t['engage']} + {t['burst']} + {t['linestrength']} AS DOUBLE) / ({t['peel']} + {t['poke']} * 0.5 + 1))"
    out["comp_scaling_type"] = f"(CAST({t['peel']} + {t['poke']} AS DOUBLE) / ({t['engage']} + {t['burst']} + 1))"
    out["comp_lane_dom_type"] = f"(({t['linestrength']} + {t['burst']}) / 10.0)"
    out["comp_teamfight_type"] = f"(({t['engage']} + {t['hardcc']}) / 10.0)"
    return out


_CB, _CR = _comp("blue"), _comp("red")
_COMP = {f"blue_{k}": v for k, v in _CB.items()} | {f"red_{k}": v for k, v in _CR.items()} | {f"diff_{k}": f"{_CB[k]} - {_CR[k]}" for k in _CB}


@query(
    "derive_composition",
    with_inputs(
        "SELECT w.gameid, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {c}" for c, e in _COMP.items()) + f" FROM games w {_TAG_JOINS}",
        "games",
        "tags",
    ),
)
def derive_composition(spark, sf):
    df = I.games(spark, sf).select("gameid", *_CH)
    return D.composition(df, I.tags(spark, sf)).select("gameid", *[(r(c) + 0.0).alias(c) for c in _COMP])


_STY = {}
for _s, _c in (("blue", _CB), ("red", _CR)):
    _STY[f"{_s}_bloodiness_x_aggression"] = f"(w.{_s}_team_bloodiness * {_c['comp_aggression_index']})"
    _STY[f"{_s}_early_power_x_snowball"] = f"({_c['comp_early_power']} * w.{_s}_team_snowball_rate)"
    _STY[f"{_s}_ckpm_x_aggression"] = f"(w.{_s}_team_avg_ckpm * {_c['comp_aggression_index']})"
    _STY[f"{_s}_wr_x_aggression"] = f"(w.{_s}_team_recent_wr * {_c['comp_aggression_index']})"
for _c in ("bloodiness_x_aggression", "early_power_x_snowball", "ckpm_x_aggression", "wr_x_aggression"):
    _STY[f"diff_{_c}"] = f"{_STY['blue_' + _c]} - {_STY['red_' + _c]}"


@query(
    "derive_style_interactions",
    with_inputs(
        "SELECT w.gameid, " + ", ".join(f"round({e}, 5) + 0.0 AS {c}" for c, e in _STY.items()) + f" FROM w {_TAG_JOINS}",
        "games",
        "tags",
        w=WIDE_SQL,
    ),
)
def derive_style_interactions(spark, sf):
    df = D.derive_features(wide(spark, sf), I.tags(spark, sf), ["style_interactions"])
    return df.select("gameid", *[(r(c, 5) + 0.0).alias(c) for c in _STY])


@query("derive_features_all")
def derive_features_all(spark, sf):
    return D.derive_features(wide(spark, sf), I.tags(spark, sf))


@query(
    "pooled_pair_features",
    "WITH d AS (SELECT vec_id % 50 AS k, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), "
    "m AS (SELECT k, i, avg(CASE WHEN label % 2 = 0 THEN CAST(v AS DOUBLE) END) AS a, avg(CASE WHEN label % 2 = 1 THEN CAST(v AS DOUBLE) END) AS b FROM d GROUP BY 1, 2) "
    "SELECT k, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0), 5) AS cosine, round(coalesce(sqrt(sum(a * a)), 10), 5) AS norm_a, "
    "round(coalesce(sqrt(sum(b * b)), 10), 5) AS norm_b, round(coalesce(sqrt(sum(a * a)) * sign(avg(a)), 10), 5) AS signed_a, round(coalesce(sqrt(sum(b * b)) * sign(avg(b)), 10), 5) AS signed_b FROM m GROUP BY k",
)
def pooled_pair_features(spark, sf):
    e = I.table(spark, sf, "embeddings").select((F.col("vec_id") % 50).alias("k"), (F.col("label") % 2).alias("side"), "embedding")
    out = D.pooled_pair_features(e, ["k"], "side", "embedding", 0, 1)
    return out.select("k", *[r(c, 5).alias(c) for c in out.columns if c != "k"])


# ---- preparation ----
def _fold_sql(i):
    e = f"CAST(m - INTERVAL {i * 2} MONTH AS DATE)"
    ts = f"CAST(CAST({e} - INTERVAL 2 MONTH AS DATE) + 1 AS DATE)"
    te = f"CAST(CAST({e} - INTERVAL 2 MONTH AS DATE) AS DATE)"
    trs = f"CAST(CAST({te} - INTERVAL 12 MONTH AS DATE) + 1 AS DATE)"
    return f"SELECT {4 - i} AS fold, {trs} AS a, {te} AS b, {ts} AS c, {e} AS d FROM m"


@query(
    "oot_folds",
    "WITH m AS (SELECT CAST(max(o_orderdate) AS DATE) AS m FROM orders), f AS (" + " UNION ALL ".join(_fold_sql(i) for i in range(4, -1, -1)) + ") "
    "SELECT f.fold, CASE WHEN CAST(o_orderdate AS DATE) BETWEEN a AND b THEN 'train' ELSE 'test' END AS split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS k "
    "FROM orders JOIN f ON CAST(o_orderdate AS DATE) BETWEEN a AND b OR CAST(o_orderdate AS DATE) BETWEEN c AND d GROUP BY 1, 2",
)
def oot_folds(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return prep.assign_folds(o, "o_orderdate").groupBy("fold", "split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("k"))


@query(
    "time_split",
    "SELECT event_id, CASE WHEN i < n - CAST(floor(n * 0.15) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM ("
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)",
)
def time_split(spark, sf):
    from pitloom.sources.matches import dense_index

    e = I.table(spark, sf, "events").select("event_id", "ts")
    i = dense_index(e, ["ts", "event_id"], [F.to_date("ts"), F.hour("ts")], "i")
    return prep.time_split(i, "i").select("event_id", "split")


@query("group_kfold", "SELECT l_orderkey, l_linenumber, CAST(('0x' || substr(md5(l_orderkey::VARCHAR), 1, 15))::BIGINT % 5 AS INTEGER) AS fold FROM lineitem")
def group_kfold(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return prep.group_kfold(li, "l_orderkey")


@query(
    "sessionise_steps",
    "SELECT event_id, user_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS match_no FROM ("
    "SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS f FROM (SELECT *, CAST(floor(value) AS BIGINT) % 20 AS s FROM events))",
)
def sessionise_steps(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", "user_id", "ts", (F.floor("value") % 20).alias("s"))
    out = prep.sessionise(e, ["user_id"], F.unix_date(F.to_date("ts")), ["ts", "event_id"], "s")
    return out.select("event_id", "user_id", "match_no")


_MIR = ["blue_top_mastery_score", "red_top_mastery_score", "tf_blue_l2norm", "tf_red_l2norm", "diff_top", "tf_win_logits"]


@query(
    "mirror_rows",
    with_inputs(
        "SELECT gameid, result, a AS blue_top_mastery_score, b AS red_top_mastery_score, a / 2 AS tf_blue_l2norm, b / 2 AS tf_red_l2norm, a - b AS diff_top, a - 1 AS tf_win_logits FROM x "
        "UNION ALL SELECT gameid, 1 - result, b, a, b / 2, a / 2, b - a + 0.0, 1 - a FROM x",
        "games",
        x="SELECT gameid, result, CAST(blue_top_kills AS DOUBLE) AS a, CAST(red_top_kills AS DOUBLE) + 0.25 AS b FROM games",
    ),
)
def mirror_rows(spark, sf):
    g = I.games(spark, sf).selectExpr("gameid", "result", "CAST(blue_top_kills AS DOUBLE) a", "CAST(red_top_kills AS DOUBLE) + 0.25 b").selectExpr(
        "gameid", "result", "a AS blue_top_mastery_score", "b AS red_top_mastery_score", "a / 2 AS tf_blue_l2norm", "b / 2 AS tf_red_l2norm",
        "a - b AS diff_top", "a - 1 AS tf_win_logits",
    )
    return prep.with_mirror(g, "result", swap=[("tf_blue_l2norm", "tf_red_l2norm")], negate=["tf_win_logits"])


@query(
    "training_weights",
    with_inputs(
        "SELECT gameid, CASE league WHEN 'LPL' THEN 1.5 WHEN 'LCK' THEN 1.2 ELSE 1.0 END AS cat_w, round(w / avg(w) OVER (), 6) AS time_w, "
        "round(greatest(exp(-ln(2) / 21 * d), 0.05) * CASE league WHEN 'LEC' THEN 0.7 WHEN 'LCS' THEN 0.8 ELSE 1.0 END, 6) AS sample_w, round(result * 0.95 + 0.025, 6) AS y FROM ("
        "SELECT *, (SELECT max(day) FROM games) - day AS d, pow(2.0, -((SELECT max(day) FROM games) - day) / 180.0) AS w FROM games)",
        "games",
    ),
)
def training_weights(spark, sf):
    g = I.games(spark, sf).select("gameid", "league", "result", "date", "day")
    top = g.agg(F.max("day").alias("m")).scalar()
    out = prep.time_decay_weight(g, "date", g.agg(F.max(F.to_date("date")).alias("m")).scalar(), out="time_w")
    return out.select(
        "gameid",
        prep.category_weight("league", {"LPL": 1.5, "LCK": 1.2}).alias("cat_w"),
        r("time_w").alias("time_w"),
        r(prep.sample_weight(top - F.col("day"), "league")).alias("sample_w"),
        r(prep.smooth_label("result")).alias("y"),
    )


@query("noise_copies")
def noise_copies(spark, sf):
    g = I.games(spark, sf).selectExpr("gameid", "league", "result", "CAST(blue_top_kills AS DOUBLE) blue_k", "CAST(red_top_kills AS DOUBLE) red_k")
    return prep.noise_copies(g, F.col("league") == "LPL", ["blue_k", "red_k"], "result")


@query(
    "oof_stitch",
    with_inputs(
        "SELECT gameid, coalesce(f, (SELECT median(f) FROM j)) AS f FROM j",
        "games",
        x="SELECT gameid, CAST(gameid % 4 AS INT) AS fold, CASE WHEN gameid % 3 = 0 THEN 'train' ELSE 'test' END AS split, CASE WHEN gameid % 5 <> 0 THEN CAST(blue_top_kills AS DOUBLE) END AS f FROM games",
        u="SELECT * FROM x UNION ALL SELECT gameid, fold + 1, 'test', f + 100 FROM x WHERE gameid % 8 = 1",
        j=(
            "SELECT g.gameid, o.f FROM games g LEFT JOIN (SELECT gameid, arg_max(f, fold * 2 + CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS f FROM u "
            "WHERE split = 'test' OR fold = 0 GROUP BY 1) o USING (gameid)"
        ),
    ),
)
def oof_stitch(spark, sf):
    g = I.games(spark, sf)
    x = g.selectExpr(
        "gameid", "CAST(gameid % 4 AS INT) fold", "CASE WHEN gameid % 3 = 0 THEN 'train' ELSE 'test' END split", "CASE WHEN gameid % 5 <> 0 THEN CAST(blue_top_kills AS DOUBLE) END f"
    )
    u = x.union(x.filter("gameid % 8 = 1").selectExpr("gameid", "fold + 1", "'test'", "f + 100"))
    return prep.oof_stitch(g.select("gameid"), u, "gameid", ["f"])


@query(
    "median_fill",
    "WITH s AS (SELECT event_id, event_id % 5 = 0 AS test, CASE WHEN event_type <> 'error' THEN value END AS x FROM events) "
    "SELECT event_id, test, coalesce(x, (SELECT median(x) FROM s WHERE NOT test)) AS x FROM s",
)
def median_fill(spark, sf):
    s = I.table(spark, sf, "events").selectExpr("event_id", "event_id % 5 = 0 AS test", "CASE WHEN event_type <> 'error' THEN value END AS x")
    a, b = prep.median_fill(s.filter("NOT test"), s.filter("test"), ["x"])
    return a.union(b)


_RANKED = "query_id, candidate_id, label, round(cs_logit, 6) AS base_score, round(greatest(exp(-ln(2) * (query_id % 120) / 21.0), 0.05), 6) AS weight"


def _ranking(spark, sf, split):
    age = prep.decay_weight(F.col("query_id") % 120, 21.0)  # a query's age in days
    f = prep.ranking_frame(I.scores(spark, sf), "query_id", "candidate_id", "cs_logit", "label", 50, split, F.greatest(age, F.lit(0.05)))
    return f.select("query_id", "candidate_id", "label", r("base_score").alias("base_score"), r("weight").alias("weight"))


def _rank_sql(split):
    base = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cs_logit DESC, candidate_id) AS rn FROM scores"
    if split == "train":
        body = f"SELECT {_RANKED} FROM b WHERE rn <= 50 AND query_id IN (SELECT query_id FROM b WHERE rn <= 50 AND label = 1)"
    else:
        body = f"SELECT {_RANKED} FROM b WHERE rn <= 50 OR label = 1"
    return with_inputs(body, "scores", b=base)


@query("ranking_frame_train", _rank_sql("train"))
def ranking_frame_train(spark, sf):
    return _ranking(spark, sf, "train")


@query("ranking_frame_val", _rank_sql("val"))
def ranking_frame_val(spark, sf):
    return _ranking(spark, sf, "val")


@query(
    "standardise",
    "WITH t AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 4 <> 0) "
    "SELECT o_orderkey, round((o_totalprice - m) / s, 6) + 0.0 AS z FROM orders, t",
)
def standardise(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("z"))
    a, b = prep.standardise(o.filter("o_orderkey % 4 <> 0"), [o.filter("o_orderkey % 4 = 0")], ["z"])
    return a.union(b).select("o_orderkey", (r("z") + 0.0).alias("z"))


@query(
    "stratified_sample",
    "WITH d AS (SELECT doc_id, lang, md5(doc_id || ':42') AS h FROM documents), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rn FROM d WHERE lang IN ('en', 'fr', 'de')) WHERE rn <= 30), "
    "o AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) AS rn FROM d WHERE doc_id NOT IN (SELECT doc_id FROM f)) "
    "SELECT doc_id, lang FROM f UNION ALL SELECT doc_id, lang FROM o WHERE rn <= 90 - (SELECT count(*) FROM f)",
)
def stratified_sample(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", "lang")
    return prep.stratified_sample(d, "lang", ["en", "fr", "de"], 90, "doc_id")


@query("holdout", "SELECT event_id, CAST(('0x' || substr(md5(event_id || ':42'), 1, 15))::BIGINT % 1000000 < 200000 AS INTEGER) AS holdout FROM events")
def holdout(spark, sf):
    e = I.table(spark, sf, "events").select("event_id")
    return prep.holdout(e, "event_id")
