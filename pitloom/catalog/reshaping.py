"""Queries for projections, filters, lookups and drafts (families B, C, P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import inputs as I
from pitloom.catalog import query
from pitloom.catalog.inputs import with_inputs
from pitloom.functions import columns as X
from pitloom.operators import draft, lookups
from pitloom.operators import reshape as rs


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("melt_players", with_inputs("SELECT gameid, day, patch, side, team, position, player_id, champion, result, kills, deaths, assists FROM player_rows", "player_rows"))
def melt_players(spark, sf):
    return rs.melt_players(I.games(spark, sf)).drop("date", "league")


@query("melt_bans", with_inputs("SELECT gameid, day, side, team, opponent, slot, champion FROM ban_rows", "ban_rows"))
def melt_bans(spark, sf):
    return rs.melt_bans(I.games(spark, sf)).drop("date", "patch")


@query(
    "melt_teams",
    with_inputs(
        "SELECT gameid, day, side, team, opponent, result, gamelength, ckpm, golddiffat15, firstdragon, firsttower, total_kills, total_deaths, "
        "total_assists, round(bloodiness, 6) AS bloodiness, led_at_15, snowball_win FROM team_rows",
        "team_rows",
    ),
)
def melt_teams(spark, sf):
    return rs.melt_teams(I.games(spark, sf)).drop("date").withColumn("bloodiness", r("bloodiness"))


@query(
    "enforce_pit",
    with_inputs("SELECT gameid, blue_team, red_team, CAST(NULL AS DOUBLE) AS xpdiff, gamelength, ckpm FROM games", "games"),
)
def enforce_pit(spark, sf):
    g = I.games(spark, sf)
    pre, post = rs.enforce_pit(g, ["gamelength", "ckpm", "xpdiff"], keep=["gameid"])
    return pre.select("gameid", "blue_team", "red_team").join(post, "gameid")


DRAFT_SQL = " UNION ALL ".join(
    f"SELECT gameid, {i} AS step, '{a}' AS action, '{s}' AS side, {n} AS slot, trim({s}_{a}{n}) AS champion FROM games"
    for i, (a, s, n) in enumerate(draft.DRAFT_ORDER)
)
LONG_SQL = "SELECT d.gameid, d.step, d.action, d.side, d.slot, coalesce(v.idx, 1) AS champion_id FROM d LEFT JOIN vocab v USING (champion)"
ARR_SQL = "SELECT gameid, list(champion_id ORDER BY step) AS seq FROM l GROUP BY gameid"


def long_draft(spark, sf):
    return draft.encode_draft(I.games(spark, sf), I.vocab(spark, sf))


@query("encode_draft", with_inputs("SELECT * FROM l", "games", "vocab", d=DRAFT_SQL, l=LONG_SQL))
def encode_draft(spark, sf):
    return long_draft(spark, sf)


@query(
    "draft_wide",
    with_inputs(
        "SELECT gameid, "
        + ", ".join(
            f"{int(a == 'pick')} AS bp_step{i}_action, {int(s == 'red')} AS bp_step{i}_side, max(CASE WHEN step = {i} THEN champion_id END) AS bp_step{i}_champion_id"
            for i, (a, s, _) in enumerate(draft.DRAFT_ORDER)
        )
        + " FROM l GROUP BY gameid",
        "games",
        "vocab",
        d=DRAFT_SQL,
        l=LONG_SQL,
    ),
)
def draft_wide(spark, sf):
    return draft.wide_draft(long_draft(spark, sf))


@query(
    "unroll_steps",
    with_inputs(
        "SELECT t.gameid, t.step, t.champion_id AS target, CAST(coalesce(sum(h.champion_id * (h.step + 1)), 0) AS BIGINT) AS prefix_code, 20 AS prefix_len "
        "FROM l t LEFT JOIN l h ON h.gameid = t.gameid AND h.step < t.step GROUP BY 1, 2, 3",
        "games",
        "vocab",
        d=DRAFT_SQL,
        l=LONG_SQL,
    ),
)
def unroll_steps(spark, sf):
    u = draft.unroll_steps(draft.draft_arrays(long_draft(spark, sf)))
    code = F.aggregate(
        F.transform("prefix", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return u.select("gameid", "step", "target", code.alias("prefix_code"), F.size("prefix").alias("prefix_len"))


@query(
    "draft_state",
    with_inputs(
        "SELECT t.gameid, t.step, t.side, t.action, count(CASE WHEN h.action = 'ban' AND h.champion_id >= 7 THEN 1 END) AS n_banned, "
        "CAST(coalesce(sum(CASE WHEN h.action = 'pick' AND h.side = t.side AND h.champion_id >= 7 THEN h.champion_id END), 0) AS BIGINT) AS ally_sum, "
        "CAST(coalesce(sum(CASE WHEN h.action = 'pick' AND h.side <> t.side AND h.champion_id >= 7 THEN h.champion_id END), 0) AS BIGINT) AS enemy_sum, "
        "arg_max(CASE WHEN h.action = 'pick' AND h.side = t.side AND h.champion_id >= 7 THEN h.champion_id END, CASE WHEN h.action = 'pick' AND h.side = t.side AND h.champion_id >= 7 THEN h.step END) AS last_ally, "
        "count(CASE WHEN h.champion_id >= 7 THEN 1 END) AS n_used, "
        "count(CASE WHEN h.action = 'ban' AND h.side = t.side THEN 1 END) + CASE WHEN t.action = 'ban' THEN 1 ELSE 0 END AS ban_step, "
        "CASE WHEN t.step IN (7, 9, 17) AND p.champion_id >= 7 THEN p.champion_id ELSE -1 END AS partner "
        "FROM l t LEFT JOIN l h ON h.gameid = t.gameid AND h.step < t.step LEFT JOIN l p ON p.gameid = t.gameid AND p.step = t.step + 1 "
        "GROUP BY t.gameid, t.step, t.side, t.action, p.champion_id",
        "games",
        "vocab",
        d=DRAFT_SQL,
        l=LONG_SQL,
    ),
)
def draft_state(spark, sf):
    u = draft.unroll_steps(draft.draft_arrays(long_draft(spark, sf)))
    s = draft.draft_state(u).withColumn("partner", draft.tuple_partner(u))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select(
        "gameid",
        "step",
        "side",
        "action",
        F.size("banned").alias("n_banned"),
        add("ally").alias("ally_sum"),
        add("enemy").alias("enemy_sum"),
        F.get("ally", F.size("ally") - 1).alias("last_ally"),
        F.size("unavailable").alias("n_used"),
        F.col("ban_step"),
        "partner",
    )


@query(
    "drop_unknown_players",
    with_inputs(
        "SELECT gameid FROM games WHERE gameid NOT IN (SELECT gameid FROM player_rows WHERE player_id NOT IN (SELECT player_id FROM k))",
        "player_rows",
        k="SELECT player_id FROM player_rows GROUP BY player_id HAVING count(*) % 9 <> 0",
    ),
)
def drop_unknown_players(spark, sf):
    p = I.player_rows(spark, sf)
    known = p.groupBy("player_id").agg(F.count("*").alias("n")).filter("n % 9 <> 0")
    ids = [f"{s}_{x}_player_id" for s in rs.SIDES for x in rs.ROLES]
    return rs.drop_unknown_players(I.games(spark, sf), ids, known).select("gameid")


@query(
    "one_hot_and_flags",
    with_inputs(
        "SELECT gameid, CASE WHEN league = 'LPL' THEN 1 ELSE 0 END AS \"league_LPL\", CASE WHEN league = 'LCK' THEN 1 ELSE 0 END AS \"league_LCK\", "
        "CASE WHEN league = 'LEC' THEN 1 ELSE 0 END AS \"league_LEC\", "
        + ", ".join(f"CASE WHEN game_num = {i} THEN 1 ELSE 0 END AS is_game_{i}" for i in range(1, 6))
        + ", game_num AS back, coalesce(first_pick_map_side, 1) AS is_blue_map_side, coalesce(playoffs, 0) AS is_playoff FROM games",
        "games",
    ),
)
def one_hot_and_flags(spark, sf):
    g = rs.normalise_flags(I.games(spark, sf))
    g = rs.one_hot_game(rs.one_hot(g, "league", ["LPL", "LCK", "LEC"]))
    return g.withColumn("back", rs.game_num_from_onehot()).select(
        "gameid", "league_LPL", "league_LCK", "league_LEC", *[f"is_game_{i}" for i in range(1, 6)], "back",
        "is_blue_map_side", "is_playoff",
    )


@query(
    "fill_and_finite",
    "SELECT event_id, CASE WHEN value > 400 THEN 0.0 WHEN event_type = 'error' THEN -1.0 ELSE value END AS recent_wr, "
    "CASE WHEN event_type = 'error' THEN 0.5 ELSE value END AS form_wr FROM events",
)
def fill_and_finite(spark, sf):
    e = I.table(spark, sf, "events")
    bad = F.when(F.col("event_type") != "error", F.col("value"))
    e = e.select(
        "event_id",
        F.when(F.col("value") > 400, F.lit(float("inf"))).otherwise(bad).alias("recent_wr"),
        bad.alias("form_wr"),
    )
    filled = rs.fill_defaults(e, {"_wr": 0.5, "recent_wr": -1.0})
    return rs.finite_columns(filled, ["recent_wr", "form_wr"])


@query(
    "feature_selection",
    with_inputs(
        "SELECT gameid, gamelength, ckpm, blue_golddiffat15, 0.0 AS not_there, CAST(0.0 AS DOUBLE) AS comp_peel FROM games", "games"
    ),
)
def feature_selection(spark, sf):
    g = I.games(spark, sf).withColumn("comp_peel", F.col("ckpm") * 3)
    cols = rs.feature_columns(g, exclude={"gameid", "result", "day"}, prefixes=("red_",))
    cols = [c for c in cols if c in ("gamelength", "ckpm", "blue_golddiffat15", "comp_peel")]
    return rs.align_columns(rs.predraft(g, cols), [*cols, "not_there"], keep=["gameid"])


@query(
    "drop_redundant",
    "SELECT s_suppkey, s_nationkey FROM supplier",
)
def drop_redundant(spark, sf):
    return rs.drop_redundant(I.table(spark, sf, "supplier"), ["^s_name$", "bal$"])


@query("parse_percent", with_inputs(f"SELECT src, round({I.DUCK_PCT}, 6) AS rate FROM pairs", "pairs"))
def parse_percent(spark, sf):
    return I.pairs(spark, sf).select("src", r(X.parse_percent("win_rate")).alias("rate"))


@query(
    "patch_index",
    with_inputs(
        "SELECT gameid, coalesce(try_cast(split_part(patch, '.', 1) AS INT) * 24 + try_cast(split_part(patch, '.', 2) AS INT), 0) AS idx FROM games",
        "games",
    ),
)
def patch_index(spark, sf):
    return I.games(spark, sf).select("gameid", X.patch_index("patch").alias("idx"))


@query(
    "valid_pairs",
    with_inputs(
        f"SELECT src, champion, opponent_name, games, round({I.DUCK_PCT}, 6) AS win_rate FROM pairs WHERE games > 0 AND {I.DUCK_PCT} BETWEEN 0 AND 1",
        "pairs",
    ),
)
def valid_pairs(spark, sf):
    p = I.pairs(spark, sf).withColumn("win_rate", X.parse_percent("win_rate"))
    return rs.valid_pairs(p).select("src", "champion", "opponent_name", "games", r("win_rate").alias("win_rate"))


# names: customers' segment words with noise against the nation names
NAME_SQL = (
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' team' WHEN 2 THEN substr(n_name, 1, 4) "
    "WHEN 3 THEN 'al-' || CAST(c_nationkey AS STRING) ELSE 'zz' || c_mktsegment END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey"
)


def raw_names(spark, sf):
    c = I.table(spark, sf, "customer").join(I.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr(
        "c_custkey",
        "CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || ' team' WHEN 2 THEN substr(n_name, 1, 4) "
        "WHEN 3 THEN 'al-' || CAST(c_nationkey AS STRING) ELSE 'zz' || c_mktsegment END AS raw",
    )


@query(
    "resolve_names",
    "WITH q AS (" + NAME_SQL + "), u AS (SELECT DISTINCT raw FROM q), "
    "al AS (SELECT 'al-' || CAST(n_nationkey AS STRING) AS alias, n_name AS team FROM nation WHERE n_nationkey % 2 = 0), "
    "f AS (SELECT u.raw, coalesce(max(e.n_name), max(al.team), arg_min(k.n_name, CAST(length(k.n_name) AS STRING) || '-' || k.n_name)) AS resolved FROM u "
    "LEFT JOIN nation e ON e.n_name = u.raw LEFT JOIN al ON al.alias = lower(trim(u.raw)) "
    "LEFT JOIN nation k ON contains(lower(k.n_name), lower(trim(u.raw))) OR contains(lower(trim(u.raw)), lower(k.n_name)) GROUP BY u.raw) "
    "SELECT q.c_custkey, q.raw, f.resolved FROM q LEFT JOIN f USING (raw)",
)
def resolve_names(spark, sf):
    n = I.table(spark, sf, "nation")
    alias = n.filter("n_nationkey % 2 = 0").selectExpr("'al-' || CAST(n_nationkey AS STRING) AS alias", "n_name AS team")
    return rs.resolve_names(raw_names(spark, sf), "raw", n.select(F.col("n_name").alias("team")), alias)


@query(
    "resolve_prefix",
    "WITH q AS (" + NAME_SQL + "), f AS (SELECT u.raw, coalesce(min(CASE WHEN lower(n.n_name) = lower(trim(u.raw)) THEN n.n_nationkey END), "
    "CASE WHEN count(DISTINCT n.n_nationkey) = 1 THEN min(n.n_nationkey) END) AS idx FROM (SELECT DISTINCT raw FROM q) u "
    "JOIN nation n ON starts_with(lower(n.n_name), lower(trim(u.raw))) GROUP BY u.raw) SELECT q.c_custkey, q.raw, f.idx FROM q LEFT JOIN f USING (raw)",
)
def resolve_prefix(spark, sf):
    n = I.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("idx"))
    return rs.resolve_prefix(raw_names(spark, sf), "raw", n)


@query(
    "normalise_player_id",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE c_name END AS pid FROM customer",
)
def normalise_player_id(spark, sf):
    c = I.table(spark, sf, "customer")
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' Unknown' WHEN 1 THEN 'nan' ELSE c_name END")
    return c.select("c_custkey", rs.normalise_player_id(raw).alias("pid"))


@query(
    "validate_requests",
    "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN s IS NULL THEN 'step_missing' END, CASE WHEN s < 0 OR s >= 20 THEN 'step_range' END, "
    "CASE WHEN n <> s THEN 'sequence_length' END, CASE WHEN g NOT BETWEEN 1 AND 5 THEN 'game_num_range' END, "
    "CASE WHEN u > 2 THEN 'blue_unknown_players' END], lambda x: x IS NOT NULL), ',') AS violations FROM ("
    "SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 23 - 1 END AS s, greatest(o_orderkey % 23 - 1 + CASE WHEN o_custkey % 8 = 0 THEN 1 ELSE 0 END, 0) AS n, "
    "o_custkey % 7 AS g, o_custkey % 5 AS u FROM orders)",
)
def validate_requests(spark, sf):
    o = I.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 23 - 1 AS INT) END AS completed_steps",
        "array_repeat(9, CAST(greatest(o_orderkey % 23 - 1 + CASE WHEN o_custkey % 8 = 0 THEN 1 ELSE 0 END, 0) AS INT)) AS bp_seq_ids",
        "'a' AS blue_team",
        "'b' AS red_team",
        "o_custkey % 7 AS game_num",
        "concat(array_repeat('unknown', CAST(o_custkey % 5 AS INT)), array_repeat('p', 5 - CAST(o_custkey % 5 AS INT))) AS blue_pids",
        "array_repeat('p', 5) AS red_pids",
    )
    v = rs.validate_requests(o, rs.recommendation_rules())
    return v.select("o_orderkey", F.array_join("violations", ",").alias("violations"))


# ---- joins and lookups ----
@query(
    "attach_team_profile",
    with_inputs(
        "SELECT g.gameid, round(coalesce(b.x, 0.5), 6) AS blue_team_wr, round(coalesce(r.x, 0.5), 6) AS red_team_wr FROM games g "
        "LEFT JOIN p b ON b.gameid = g.gameid AND b.team = g.blue_team LEFT JOIN p r ON r.gameid = g.gameid AND r.team = g.red_team",
        "team_rows",
        p="SELECT gameid, team, CASE WHEN gameid % 7 <> 0 THEN total_kills / 60.0 END AS x FROM team_rows",
    ),
)
def attach_team_profile(spark, sf):
    g = I.games(spark, sf)
    wr = F.when(F.col("gameid") % 7 != 0, F.col("total_kills") / 60)  # so that some values are missing
    store = rs.melt_teams(g).select("gameid", "team", wr.alias("team_wr"))
    out = lookups.attach_team_profile(g.select("gameid", "blue_team", "red_team"), store, {"team_wr": 0.5}, order=["team_wr"])
    return out.select("gameid", r("blue_team_wr").alias("blue_team_wr"), r("red_team_wr").alias("red_team_wr"))


_SLOTS = [(s, x) for s in rs.SIDES for x in rs.ROLES]


def _slot_sql(col: str, keys: str, default: str) -> dict[str, str]:
    """SQL parts of a slot lookup: every slot of every game (`seat`), and the joined values (`met`)."""
    slots = ", ".join(f"{{'slot': '{s}_{x}', 'player_id': {s}_{x}_player_id, 'champion': {s}_{x}_champion}}" for s, x in _SLOTS)
    return {
        "seat": f"SELECT gameid, day, u.slot AS slot, u.player_id AS player_id, u.champion AS champion FROM (SELECT gameid, day, unnest([{slots}]) AS u FROM games)",
        "met": f"SELECT seat.gameid, seat.slot, coalesce(p.{col}, {default}) AS v FROM seat LEFT JOIN p USING ({keys})",
    }


def _folded(col: str, value: str) -> str:
    return "SELECT gameid, " + ", ".join(f"{value.format(f"max(CASE WHEN slot = '{s}_{x}' THEN v END)")} AS {s}_{x}_{col}" for s, x in _SLOTS) + " FROM met GROUP BY gameid"


@query(
    "attach_player_features",
    with_inputs(
        _folded("f", "round({}, 6)"),
        "player_rows",
        p="SELECT gameid, player_id, champion, CASE WHEN (gameid + kills) % 5 <> 0 THEN (kills + 1.0) / (deaths + 1.0) END AS f FROM player_rows",
        **_slot_sql("f", "gameid, player_id, champion", "0.0"),
    ),
)
def attach_player_features(spark, sf):
    f = F.when((F.col("gameid") + F.col("kills")) % 5 != 0, (F.col("kills") + 1) / (F.col("deaths") + 1))  # some values are missing
    store = I.player_rows(spark, sf).select("gameid", "player_id", "champion", f.alias("f"))
    out = lookups.attach_slots(I.games(spark, sf), store, ["gameid", "player_id", "champion"], {"f": 0.0})
    return out.select("gameid", *[r(f"{s}_{x}_f").alias(f"{s}_{x}_f") for s, x in _SLOTS])


@query(
    "attach_meta_features",
    with_inputs(
        _folded("m", "{}"),
        "player_rows",
        p="SELECT day, champion, CASE WHEN count(*) % 3 <> 0 THEN count(*) END AS m FROM player_rows GROUP BY 1, 2",
        **_slot_sql("m", "day, champion", "0"),
    ),
)
def attach_meta_features(spark, sf):
    n = F.count("*")
    store = I.player_rows(spark, sf).groupBy("day", "champion").agg(F.when(n % 3 != 0, n).alias("m"))  # some values are missing
    out = lookups.attach_slots(I.games(spark, sf), store, ["day", "champion"], {"m": 0})
    return out.select("gameid", *[f"{s}_{x}_m" for s, x in _SLOTS])


@query(
    "career_anti_join",
    with_inputs(
        "SELECT player_id, champion, games FROM career c WHERE NOT EXISTS (SELECT 1 FROM player_rows p WHERE p.player_id = c.player_id AND p.champion = c.champion)",
        "player_rows",
        "career",
    ),
)
def career_anti_join(spark, sf):
    from pitloom.operators.rates import career_only

    return career_only(I.player_rows(spark, sf), I.career(spark, sf)).select("player_id", "champion", "games")


@query(
    "compare_periods",
    "WITH b AS (SELECT p_brand, l_quantity, l_shipdate FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "x AS (SELECT p_brand, count(*) AS n, round(avg(l_quantity), 6) AS q FROM b WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1), "
    "y AS (SELECT p_brand, count(*) AS n, round(avg(l_quantity), 6) AS q FROM b WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1) "
    "SELECT coalesce(x.p_brand, y.p_brand) AS p_brand, coalesce(x.n, 0) AS n_before, coalesce(y.n, 0) AS n_after, coalesce(y.n, 0) - coalesce(x.n, 0) AS n_change, "
    "round(coalesce(y.q, 0) - coalesce(x.q, 0), 5) AS q_change FROM x FULL JOIN y ON x.p_brand = y.p_brand",
)
def compare_periods(spark, sf):
    li = I.table(spark, sf, "lineitem").join(I.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    agg = lambda d: d.groupBy("p_brand").agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("q"))
    d = F.col("l_shipdate")
    a = agg(li.filter(d < F.lit("1996-01-01").cast("timestamp_ntz")))
    b = agg(li.filter(d >= F.lit("2000-01-01").cast("timestamp_ntz")))
    c = lookups.compare_periods(a, b, ["p_brand"], ["n", "q"])
    return c.select("p_brand", "n_before", "n_after", "n_change", r("q_change", 5).alias("q_change"))


@query(
    "games_in_window",
    with_inputs("SELECT gameid FROM games WHERE day BETWEEN (SELECT max(day) FROM games) - 200 AND (SELECT max(day) FROM games) - 100", "games"),
)
def games_in_window(spark, sf):
    g = I.games(spark, sf).select("gameid", "day")
    top = g.agg(F.max("day").alias("m"))
    return lookups.in_window(g, "day", top.scalar() - 200, top.scalar() - 100).select("gameid")


PAIR_RATE = f"SELECT champion, opponent_name, position, games, {I.DUCK_PCT} AS wr, src FROM pairs WHERE {I.DUCK_PCT} IS NOT NULL"


def lanes(spark, sf):
    g = I.games(spark, sf)
    lane = [
        F.struct(F.lit(x).alias("position"), F.col(f"blue_{x}_champion").alias("a"), F.col(f"red_{x}_champion").alias("b"))
        for x in rs.ROLES
    ]
    return g.select("gameid", F.inline(F.array(*lane)))


LANES_SQL = " UNION ALL ".join(
    f"SELECT gameid, '{x}' AS position, blue_{x}_champion AS a, red_{x}_champion AS b FROM games" for x in rs.ROLES
)


@query(
    "lookup_matchup",
    with_inputs(
        "SELECT l.gameid, l.position, round(coalesce(e.wr, y.wr, 1 - re.wr, 1 - ry.wr), 6) AS win_rate FROM l "
        "LEFT JOIN e ON e.champion = l.a AND e.opponent_name = l.b AND e.position = l.position LEFT JOIN y ON y.champion = l.a AND y.opponent_name = l.b "
        "LEFT JOIN e re ON re.champion = l.b AND re.opponent_name = l.a AND re.position = l.position LEFT JOIN y ry ON ry.champion = l.b AND ry.opponent_name = l.a",
        "games",
        "pairs",
        l=LANES_SQL,
        p=PAIR_RATE,
        e="SELECT champion, opponent_name, position, arg_max(wr, CAST(games AS BIGINT) * 1000000000 - src) AS wr FROM p GROUP BY 1, 2, 3",
        y="SELECT champion, opponent_name, arg_max(wr, CAST(games AS BIGINT) * 1000000000 - src) AS wr FROM p GROUP BY 1, 2",
    ),
)
def lookup_matchup(spark, sf):
    p = I.pairs(spark, sf).withColumn("win_rate", X.parse_percent("win_rate")).filter("win_rate is not null")
    out = lookups.lookup_matchup(lanes(spark, sf), p, order=[F.col("games"), -F.col("src")])
    return out.select("gameid", "position", r("win_rate").alias("win_rate"))


@query(
    "lookup_synergy",
    with_inputs(
        "SELECT l.gameid, l.position, round(s.wr, 6) AS win_rate FROM l LEFT JOIN s ON s.x = least(l.a, l.b) AND s.y = greatest(l.a, l.b)",
        "games",
        "pairs",
        l=LANES_SQL,
        p=PAIR_RATE,
        s="SELECT least(champion, opponent_name) AS x, greatest(champion, opponent_name) AS y, arg_min(wr, src) AS wr FROM p GROUP BY 1, 2",
    ),
)
def lookup_synergy(spark, sf):
    p = I.pairs(spark, sf).withColumn("win_rate", X.parse_percent("win_rate")).filter("win_rate is not null")
    out = lookups.lookup_synergy(lanes(spark, sf), p, "a", "b", order=[F.col("src")])
    return out.select("gameid", "position", r("win_rate").alias("win_rate"))


@query(
    "champion_stats_tiers",
    with_inputs(
        "SELECT l.gameid, l.position, CASE WHEN a.p > 0 THEN 1 WHEN b.p > 0 THEN 2 WHEN c.p > 0 THEN 3 END AS tier, "
        "coalesce(CASE WHEN a.p > 0 THEN a.p END, CASE WHEN b.p > 0 THEN b.p END, CASE WHEN c.p > 0 THEN c.p END) AS presence FROM l "
        "LEFT JOIN a ON a.champion = l.a AND a.position = l.position LEFT JOIN b ON b.champion = l.a LEFT JOIN c ON c.champion = l.a",
        "games",
        "pairs",
        l=LANES_SQL,
        a="SELECT champion, position, sum(CASE WHEN matchup_type = 'easy' AND games >= 8 THEN games ELSE 0 END)::BIGINT AS p FROM pairs GROUP BY 1, 2",
        b="SELECT champion, sum(CASE WHEN matchup_type = 'hard' AND games >= 12 THEN games ELSE 0 END)::BIGINT AS p FROM pairs GROUP BY 1",
        c="SELECT champion, count(*) AS p FROM pairs GROUP BY 1",
    ),
)
def champion_stats_tiers(spark, sf):
    p = I.pairs(spark, sf)
    part = lambda test: F.sum(F.when(F.expr(test), F.col("games")).otherwise(0)).alias("presence")
    ranks = p.groupBy("champion", "position").agg(part("matchup_type = 'easy' AND games >= 8"))
    merged = p.groupBy("champion").agg(part("matchup_type = 'hard' AND games >= 12"))
    base = p.groupBy("champion").agg(F.count("*").alias("presence"))
    lineup = lanes(spark, sf).select("gameid", "position", F.col("a").alias("champion"))
    out = lookups.tiered(
        lineup, [(ranks, ["champion", "position"]), (merged, ["champion"]), (base, ["champion"])], "presence", ["presence"]
    )
    return out.select("gameid", "position", "tier", "presence")


# ---- sorts, limits, sets ----
@query(
    "order_total",
    with_inputs("SELECT gameid, row_number() OVER (ORDER BY day, gameid) - 1 AS match_seq_idx FROM games", "games"),
)
def order_total(spark, sf):
    from pitloom.sources.matches import dense_index

    g = I.games(spark, sf).select("gameid", "date", "day")
    out = dense_index(g, ["day", "gameid"], [F.col("day"), F.floor(F.col("gameid") / 4096)], "match_seq_idx")
    return out.select("gameid", "match_seq_idx")


@query(
    "top_n_keep_all",
    "SELECT o_orderkey, t FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS t, rank() OVER (ORDER BY floor(o_totalprice / 1000) DESC) AS rk FROM orders) WHERE rk <= 10",
)
def top_n_keep_all(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("t"))
    return rs.top_n(o, "t", 10, keep="all")


@query(
    "union_and_sets",
    "SELECT 'union' AS op, count(*) AS n FROM (SELECT l_suppkey AS k FROM lineitem UNION SELECT s_suppkey FROM supplier) UNION ALL "
    "SELECT 'both', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL "
    "SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)",
)
def union_and_sets(spark, sf):
    li, s = I.table(spark, sf, "lineitem"), I.table(spark, sf, "supplier")
    o, c = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), I.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    u = rs.union_distinct(li.select(F.col("l_suppkey").alias("k")), s.select(F.col("s_suppkey").alias("k")))
    parts = {"union": u, "both": o.intersect(c), "only": c.exceptAll(o.distinct())}
    return rs.union_all(*[d.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, d in parts.items()])


@query("distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_pairs(spark, sf):
    return I.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
