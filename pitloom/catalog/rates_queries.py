"""Queries for sources, counts, priors, smoothing and shares (families A, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import inputs as I
from pitloom.catalog import query
from pitloom.catalog.inputs import with_inputs
from pitloom.catalog.windows import PRIOR_TABLE_SQL
from pitloom.functions import columns as X
from pitloom.operators import rates
from pitloom.operators import reshape as rs
from pitloom.sources import matches, stores_io


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _written_root(spark, name):
    import uuid

    from pitloom.streaming.jobs import checkpoint_root

    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "history_cut",
    "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) - INTERVAL 18 MONTH AS DATE) FROM orders)",
)
def history_cut(spark, sf):
    return matches.history_cut(I.table(spark, sf, "orders"), 18, "o_orderdate").select("o_orderkey")


@query("date_range", "SELECT CAST(min(ts) AS VARCHAR)[1:19] AS first, CAST(max(ts) AS VARCHAR)[1:19] AS last FROM events")
def date_range(spark, sf):
    d = matches.date_range(I.table(spark, sf, "events"), "ts")
    return d.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last")])


@query(
    "load_pairs_fallback",
    with_inputs(f"SELECT champion, opponent_name, games, round({I.DUCK_PCT}, 6) AS win_rate FROM pairs", "pairs"),
)
def load_pairs_fallback(spark, sf):
    p = I.pairs(spark, sf)
    primary = p.select("champion", F.col("opponent_name").alias("opponent"), "games", F.lit("n/a").alias("winrate"))
    secondary = p.select(F.col("champion").alias("champion_name"), "opponent_name", F.col("games").alias("matches"), "win_rate")
    out = matches.load_pairs(primary, secondary)
    return out.select("champion", "opponent_name", "games", r("win_rate").alias("win_rate"))


@query(
    "rosters",
    with_inputs(
        "SELECT league, array_to_string(list_sort(list(DISTINCT team)), ',') AS teams, count(DISTINCT player_id) AS n_players FROM player_rows GROUP BY league",
        "player_rows",
    ),
)
def rosters(spark, sf):
    p = I.player_rows(spark, sf).select("league", "team", "player_id", F.col("position").alias("role")).distinct()
    n = p.groupBy("league").agg(F.count_distinct("player_id").alias("n_players"))
    return matches.league_teams(p).select("league", F.array_join("teams", ",").alias("teams")).join(n, "league")


@query(
    "roster_players",
    with_inputs(
        "SELECT league, team, string_agg(player_id, ',' ORDER BY o, player_id) AS players FROM ("
        "SELECT DISTINCT league, team, player_id, position, CASE position WHEN 'top' THEN 1 WHEN 'jng' THEN 2 WHEN 'mid' THEN 3 WHEN 'bot' THEN 4 WHEN 'sup' THEN 5 END AS o FROM player_rows) GROUP BY 1, 2",
        "player_rows",
    ),
)
def roster_players(spark, sf):
    p = I.player_rows(spark, sf).select("league", "team", "player_id", F.col("position").alias("role")).distinct()
    return matches.team_players(p).select("league", "team", F.array_join("players", ",").alias("players"))


@query(
    "vocab_and_prior",
    with_inputs(
        "SELECT v.champion, v.idx, position, round(p, 6) AS probability FROM vocab v JOIN (SELECT champion, unnest(['top', 'jng', 'mid', 'bot', 'sup']) AS position, unnest([pos_top, pos_jng, pos_mid, pos_bot, pos_sup]) AS p FROM prior) USING (champion)",
        "vocab",
        "prior",
    ),
)
def vocab_and_prior(spark, sf):
    """Both tables are written as the JSON files that the loaders read; they have a row for each champion."""
    root = _written_root(spark, "json")
    v, p = I.vocab(spark, sf), I.position_prior(spark, sf)
    names = v.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("champion", "idx"))).alias("name_to_idx"))))
    names.coalesce(1).write.text(f"{root}/vocab")
    parts = F.map_from_arrays(F.array(*[F.lit(x) for x in rs.ROLES]), F.array(*[F.col(f"pos_{x}") for x in rs.ROLES]))
    p.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("champion"), parts.alias("p")))))).coalesce(1).write.text(f"{root}/prior")
    out = matches.load_vocab(spark, f"{root}/vocab").join(matches.load_position_prior(spark, f"{root}/prior"), "champion")
    return out.select("champion", "idx", "position", r("probability").alias("probability"))


@query("career_file", with_inputs("SELECT player_id, champion, games FROM career", "career"))
def career_file(spark, sf):
    """The table as a file that the loader reads, with what a file that does not exist gives."""
    root = _written_root(spark, "career")
    I.career(spark, sf).select("player_id", "champion", "games", "win_rate", "kda").write.option("header", True).csv(f"{root}/career.csv")
    both = matches.load_career(spark, f"{root}/career.csv").unionByName(matches.load_career(spark, f"{root}/none.csv"))
    return both.select("player_id", "champion", F.col("games").cast("long").alias("games"))


@query("written_store", with_inputs("SELECT gameid, player_id, champion, league FROM player_rows", "player_rows"))
def written_store(spark, sf):
    root = _written_root(spark, "store")
    stores_io.save_store(I.player_rows(spark, sf).select("gameid", "player_id", "champion", "league"), f"{root}/players", ["league"])
    return spark.read.parquet(f"{root}/players").select("gameid", "player_id", "champion", "league")


@query("refreshed_counts", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def refreshed_counts(spark, sf):
    """Two periodic runs: the second sees the files only that came since the first. A batch's partial sums are its own folder."""
    from pitloom.streaming import jobs

    root = _written_root(spark, "refresh")
    e = I.ev(spark, sf).select("event_id", "user_id", "value")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))

    def update(batch, number):
        sums = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        sums.write.mode("overwrite").parquet(f"{root}/store/batch={number}")

    for k in (0, 1):
        e.filter(half == k).write.mode("append").parquet(f"{root}/in")
        jobs.refresh(spark, f"{root}/in", e.schema, f"{root}/ckpt", update)
    return spark.read.parquet(f"{root}/store").groupBy("user_id").agg(F.sum("n").alias("n"), r(F.sum("total"), 4).alias("total"))


@query(
    "store_manifest",
    with_inputs(
        "SELECT 'players' AS store, count(*) AS rows, count(DISTINCT player_id) AS keys, min(day) AS first_day, max(day) AS last_day FROM player_rows UNION ALL "
        "SELECT 'teams', count(*), count(DISTINCT team), min(day), max(day) FROM team_rows",
        "player_rows",
        "team_rows",
    ),
)
def store_manifest(spark, sf):
    p, t = I.player_rows(spark, sf), rs.melt_teams(I.games(spark, sf))
    return stores_io.manifest({"players": (p, "player_id", "day"), "teams": (t, "team", "day")})


@query(
    "export_nested_json",
    "SELECT l_returnflag AS k1, count(DISTINCT l_linestatus) AS n_inner, sum(CASE WHEN p > 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaf FROM ("
    "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS p FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1",
)
def export_nested_json(spark, sf):
    li = I.table(spark, sf, "lineitem")
    flat = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_quantity").alias("rate"))
    j = stores_io.nest_json(flat, ["l_returnflag", "l_linestatus", "l_linenumber"], ["rate"])
    # read the text back: it must hold every inner key and leaf
    m = F.from_json("json", "MAP<STRING, MAP<STRING, STRUCT<rate: DOUBLE>>>")
    leaves = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + F.size(x))
    return j.select(F.col("l_returnflag").alias("k1"), F.size(F.map_keys(m)).cast("long").alias("n_inner"), leaves.alias("n_leaf"))


@query(
    "props_fields",
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY event_type",
)
def props_fields(spark, sf):
    e = I.table(spark, sf, "events").withColumn("k", F.from_json("props", "k BIGINT")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


_KEPT = "('0x' || substr(md5('42:' || {key}), 1, 15))::BIGINT < {part}"
_HALF = int(0.5 * (1 << 60))
_LOG_DAY = "CAST(floor(epoch_us(ts) / 8.64e10) AS BIGINT)"


@query(
    "inference_log",
    f"WITH e AS (SELECT event_id, event_type, value, {_LOG_DAY} AS day FROM events), r AS (SELECT event_id, day, value, CAST(NULL AS DOUBLE) AS extra FROM e WHERE {_KEPT.format(key='event_id::VARCHAR', part=_HALF)} "
    "UNION ALL SELECT event_id, day, value, value * 2 FROM e WHERE event_type = 'error') SELECT event_id, day, value, extra FROM r WHERE day > (SELECT max(day) FROM e) - 7",
)
def inference_log(spark, sf):
    """Half of the events as one batch, written twice as after a loss, and the errors with one more column as a second; the last seven days are read."""
    root = _written_root(spark, "log")
    e = I.ev(spark, sf).select(F.col("event_id").alias("request_id"), F.col("ts").alias("timestamp"), "event_type", "value")
    for _ in range(2):
        stores_io.append_log(e, root, "m", 0, rate=0.5)
    stores_io.append_log(e.filter("event_type = 'error'").withColumn("extra", F.col("value") * 2), root, "m", 1)
    last = e.agg(F.max(F.to_date("timestamp"))).first()[0]
    back = stores_io.read_logs(spark, root, "m", 7, last)
    return back.select(F.col("request_id").alias("event_id"), F.unix_date("dt").cast("long").alias("day"), "value", "extra")


@query(
    "inference_log_stream",
    f"SELECT event_id, {_LOG_DAY} AS day, value FROM events WHERE {_KEPT.format(key='event_id::VARCHAR', part=_HALF)}",
)
def inference_log_stream(spark, sf):
    from pitloom.streaming import jobs

    e, _ = I.staged_stream(spark, I.ev(spark, sf).select("event_id", "ts", "value"), "ts")
    root = _written_root(spark, "log")
    jobs.log_sink(e.filter("event_id >= 0"), f"{root}/log", f"{root}/ckpt", "m", ts="ts", rate=0.5, key=["event_id"]).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/log").select("event_id", F.unix_date("dt").cast("long").alias("day"), "value")


@query(
    "candidate_log",
    with_inputs("SELECT query_id, candidate_id, cs_logit, nocs_logit, CAST(label AS DOUBLE) AS label FROM scores WHERE mask = 1", "scores"),
)
def candidate_log(spark, sf):
    root = _written_root(spark, "log")
    rows = I.scores(spark, sf).withColumn("timestamp", F.timestamp_seconds(F.col("query_id") % 5 * 86_400))
    for _ in range(2):
        stores_io.append_candidate_log(rows, root, "m", 0, key=["query_id", "candidate_id"])
    return stores_io.read_logs(spark, root, "m", 5, "1970-01-05").select("query_id", "candidate_id", "cs_logit", "nocs_logit", "label")


@query(
    "pair_counts",
    with_inputs("SELECT player_id, champion, count(*) AS games, CAST(sum(result) AS BIGINT) AS wins FROM player_rows GROUP BY 1, 2", "player_rows"),
)
def pair_counts(spark, sf):
    return rates.pair_counts(I.player_rows(spark, sf), ["player_id", "champion"])


@query(
    "base_prior",
    with_inputs("SELECT player_id, champion, CAST(base_g AS DOUBLE) AS base_g, round(base_w, 6) AS base_w FROM b", "player_rows", "career", b=PRIOR_TABLE_SQL),
)
def base_prior(spark, sf):
    return rates.base_prior(I.player_rows(spark, sf), I.career(spark, sf)).withColumn("base_w", r("base_w"))


@query(
    "leakage_ratio",
    with_inputs(
        "SELECT round(x, 6) AS ratio, x > 1.1 AS leaks FROM (SELECT CAST((SELECT sum(base_g) FROM b) + (SELECT count(*) FROM player_rows) AS DOUBLE) / (SELECT sum(games) FROM career) AS x)",
        "player_rows",
        "career",
        b=PRIOR_TABLE_SQL,
    ),
)
def leakage_ratio(spark, sf):
    h, c = I.player_rows(spark, sf), I.career(spark, sf)
    return rates.leakage_ratio(rates.base_prior(h, c), h, c).withColumn("ratio", r("ratio"))


@query(
    "smoothed_rates",
    "SELECT p_brand, round((w + 2 * 0.5) / (n + 2), 6) AS bayes, round((w + 1.0) / (n + 2), 6) AS laplace FROM ("
    "SELECT p_brand, count(*) AS n, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)",
)
def smoothed_rates(spark, sf):
    li = I.table(spark, sf, "lineitem").join(I.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a = li.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("w"))
    return a.select("p_brand", r(X.bayes_rate("w", "n")).alias("bayes"), r(X.laplace_rate("w", "n")).alias("laplace"))


_EVEN = "round_even({x}, 0)"


def _counter_sql(clip):
    filt = "AND games >= 5" if clip else ""
    wr = "least(greatest(wr, 0.1), 0.9)" if clip else "wr"
    raw = "least(greatest(w, 0.1), 0.9)" if clip else "w"
    return with_inputs(
        f"SELECT champion, opponent_name, round(CASE WHEN g > 0 THEN (round_even(w * g, 0) + 1.0) / (g + 2) ELSE {raw} END, 6) AS win_rate, mt AS matchup_type FROM ("
        "SELECT a.champion, a.opponent_name, CASE WHEN flip THEN round(1 - bwr, 6) ELSE awr END AS w, CASE WHEN flip THEN bg ELSE ag END AS g, "
        "CASE WHEN flip THEN CASE WHEN bmt = 'hard' THEN 'easy' ELSE 'hard' END ELSE amt END AS mt FROM ("
        "SELECT a.champion, a.opponent_name, a.wr AS awr, a.g AS ag, a.mt AS amt, b.wr AS bwr, b.g AS bg, b.mt AS bmt, "
        "coalesce(b.wr IS NOT NULL AND a.champion <> a.opponent_name AND abs(a.wr + b.wr - 1) > 0.02 AND NOT (a.g > b.g OR (a.g = b.g AND a.pos < b.pos)), false) AS flip "
        "FROM o a LEFT JOIN o b ON a.champion = b.opponent_name AND a.opponent_name = b.champion) a)",
        "pairs",
        p=f"SELECT champion, opponent_name, games, {wr} AS wr, matchup_type, src FROM (SELECT *, {I.DUCK_PCT} AS wr FROM pairs) WHERE wr BETWEEN 0 AND 1 AND games > 0 {filt}",
        o=(
            "SELECT champion, opponent_name, arg_max(wr, CAST(games AS BIGINT) * 1000000000 - src) AS wr, max(games) AS g, "
            "arg_max(matchup_type, CAST(games AS BIGINT) * 1000000000 - src) AS mt, min(src) AS pos FROM p GROUP BY 1, 2"
        ),
    )


def clean_pairs(spark, sf):
    return rs.valid_pairs(I.pairs(spark, sf).withColumn("win_rate", X.parse_percent("win_rate")))


@query("counter_lookup", _counter_sql(False))
def counter_lookup(spark, sf):
    return rates.counter_lookup(clean_pairs(spark, sf)).withColumn("win_rate", r("win_rate"))


@query("counter_lookup_clipped", _counter_sql(True))
def counter_lookup_clipped(spark, sf):
    return rates.counter_lookup(clean_pairs(spark, sf), clip_extreme=True).withColumn("win_rate", r("win_rate"))


def _synergy_sql(clip):
    fix = "SELECT x, y, round_even(least(greatest(w / g, 0.1), 0.9) * g, 0) AS w, g FROM s WHERE g >= 5" if clip else "SELECT * FROM s"
    return with_inputs(
        f"SELECT x AS champion_a, y AS champion_b, round((w + 1.0) / (g + 2), 6) AS win_rate FROM ({fix})",
        "pairs",
        s=(
            f"SELECT least(champion, opponent_name) AS x, greatest(champion, opponent_name) AS y, sum(round_even({I.DUCK_PCT} * games, 0)) AS w, sum(games) AS g "
            f"FROM pairs WHERE games > 0 AND {I.DUCK_PCT} BETWEEN 0 AND 1 GROUP BY 1, 2"
        ),
    )


@query("synergy_lookup", _synergy_sql(False))
def synergy_lookup(spark, sf):
    return rates.synergy_lookup(clean_pairs(spark, sf)).withColumn("win_rate", r("win_rate"))


@query("synergy_lookup_clipped", _synergy_sql(True))
def synergy_lookup_clipped(spark, sf):
    return rates.synergy_lookup(clean_pairs(spark, sf), clip_extreme=True).withColumn("win_rate", r("win_rate"))


SEASON_SQL = (
    "SELECT p_brand AS champion, p_type AS position, year(l_shipdate) AS season, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS picks, "
    "count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS bans, count(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 1 END) AS wins, "
    "CAST(round(avg(l_quantity)) AS BIGINT) AS dpm FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"
)


def season_rows(spark, sf):
    li = I.table(spark, sf, "lineitem").join(I.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    f, n = F.col("l_linestatus") == "F", F.col("l_returnflag") == "N"
    return li.groupBy(
        F.col("p_brand").alias("champion"), F.col("p_type").alias("position"), F.year("l_shipdate").alias("season")
    ).agg(
        F.count_if(f).alias("picks"),
        F.count_if(F.col("l_linestatus") == "O").alias("bans"),
        F.count_if(f & n).alias("wins"),
        F.round(F.avg("l_quantity")).cast("long").alias("dpm"),
    )


@query(
    "season_stats",
    "WITH s AS (" + SEASON_SQL + "), a AS (SELECT champion, CAST(sum(picks) AS BIGINT) AS picks, CAST(sum(bans) AS BIGINT) AS bans, CAST(sum(wins) AS BIGINT) AS wins, "
    "CAST(sum(dpm * picks) AS DOUBLE) / nullif(sum(picks), 0) AS dpm FROM s GROUP BY 1), t AS (SELECT CAST(ceil(sum(picks) / 10.0) AS BIGINT) AS n FROM a) "
    "SELECT champion, picks, bans, wins, round(dpm, 6) AS dpm, n AS total_games, round(picks / n, 6) AS pick_rate, round(bans / n, 6) AS ban_rate, round(wins / nullif(picks, 0), 6) AS win_rate FROM a, t",
)
def season_stats(spark, sf):
    s = rates.season_stats(season_rows(spark, sf), ["champion"], ["picks", "bans", "wins"], ["dpm"])
    return s.withColumns({c: r(c) for c in ("dpm", "pick_rate", "ban_rate", "win_rate")})


@query(
    "group_rate",
    "SELECT l_suppkey % 10 AS k, l_linestatus, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 20",
)
def group_rate(spark, sf):
    li = I.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("k"), "l_linestatus", (F.col("l_returnflag") == "N").cast("int").alias("w")
    )
    return rates.group_rate(li, ["k", "l_linestatus"], "w", 20).withColumn("rate", r("rate"))


@query(
    "team_average",
    with_inputs(
        "SELECT t.team, s.champion, round((sum(s.f) + 0.5 * (n.n - count(*))) / n.n, 6) AS f FROM t JOIN s USING (player_id) JOIN (SELECT team, count(*) AS n FROM t GROUP BY 1) n ON n.team = t.team GROUP BY t.team, s.champion, n.n",
        "player_rows",
        t="SELECT DISTINCT team, player_id FROM player_rows",
        s="SELECT player_id, champion, CAST(arg_max(kills, day * 1000000000 + gameid) AS DOUBLE) AS f FROM player_rows GROUP BY 1, 2",
    ),
)
def team_average(spark, sf):
    from pitloom.operators.asof import latest

    p = I.player_rows(spark, sf)
    store = latest(p, ["player_id", "champion"], ["day", "gameid"], ["kills"]).withColumnRenamed("kills", "f")
    return rates.team_average(store, p.select("team", "player_id").distinct(), ["f"], {"f": 0.5}).withColumn("f", r("f"))


@query(
    "rookie_fill",
    with_inputs(
        "SELECT gameid, team, player_id, round(coalesce(k, avg(k) OVER (PARTITION BY gameid, team) * 0.85, 3.0), 6) AS kda FROM ("
        "SELECT gameid, team, player_id, CASE WHEN (gameid + kills) % 4 <> 0 THEN (kills + assists) / (deaths + 1.0) END AS k FROM player_rows)",
        "player_rows",
    ),
)
def rookie_fill(spark, sf):
    from pitloom.operators.derive import rookie_fill as fill

    p = I.player_rows(spark, sf)
    known = (F.col("gameid") + F.col("kills")) % 4 != 0
    p = p.select("gameid", "team", "player_id", F.when(known, (F.col("kills") + F.col("assists")) / (F.col("deaths") + 1)).alias("kda"), (~known).alias("unknown"))
    out = fill(p, ["gameid", "team"], "unknown", {"kda": 0.85}, {"kda": 3.0})
    return out.select("gameid", "team", "player_id", r("kda").alias("kda"))


@query(
    "null_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END) > 0.3 AS flagged FROM lineitem"
        for c, e in {"a": "nullif(l_returnflag, 'R')", "b": "nullif(l_linestatus, 'O')", "c": "l_tax"}.items()
    ),
)
def null_rates(spark, sf):
    li = I.table(spark, sf, "lineitem").selectExpr("nullif(l_returnflag, 'R') a", "nullif(l_linestatus, 'O') b", "l_tax c")
    return rates.null_rates(li, ["a", "b", "c"]).withColumn("null_rate", r("null_rate"))


@query(
    "coverage",
    "SELECT count(*) AS rows, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem",
)
def coverage(spark, sf):
    return rates.coverage(I.table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@query(
    "metric_levels",
    with_inputs(
        "SELECT segment, fold, count(*) AS n, round(avg(y), 6) AS rate FROM preds GROUP BY GROUPING SETS ((), (segment), (segment, fold))", "preds"
    ),
)
def metric_levels(spark, sf):
    aggs = [F.count("*").alias("n"), r(F.avg("y")).alias("rate")]
    return rates.metric_levels(I.preds(spark, sf), [[], ["segment"], ["segment", "fold"]], aggs)


@query(
    "mean_std",
    with_inputs(
        "SELECT segment, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, array_to_string(list(round(m, 4) ORDER BY fold), ',') AS vals FROM ("
        "SELECT segment, fold, avg(y) AS m FROM preds GROUP BY 1, 2) GROUP BY 1",
        "preds",
    ),
)
def mean_std(spark, sf):
    per = I.preds(spark, sf).groupBy("segment", "fold").agg(F.avg("y").alias("m"))
    out = rates.mean_std(per, ["segment"], "m", "fold")
    vals = F.array_join(F.transform("values", lambda v: F.round(v, 4).cast("string")), ",")
    return out.select("segment", r("mean").alias("mean"), r("std").alias("std"), vals.alias("vals"))


@query(
    "top_share",
    "SELECT l_suppkey, l_linenumber, n, round(CAST(n AS DOUBLE) / t, 6) AS share, rank FROM (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS t, "
    "row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, l_linenumber) AS rank FROM ("
    "SELECT l_suppkey, l_linenumber, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3",
)
def top_share(spark, sf):
    li = I.table(spark, sf, "lineitem")
    return rates.top_share(li, ["l_suppkey"], "l_linenumber", ["l_orderkey"], 3).withColumn("share", r("share"))


@query(
    "main_position_stats",
    "WITH s AS (SELECT champion, position, CAST(sum(picks + bans) AS BIGINT) AS presence, CAST(sum(wins) AS BIGINT) AS wins FROM (" + SEASON_SQL + ") GROUP BY 1, 2) "
    "SELECT champion, position, presence, wins FROM (SELECT *, row_number() OVER (PARTITION BY champion ORDER BY presence DESC, position) AS rn FROM s) WHERE rn = 1",
)
def main_position_stats(spark, sf):
    s = season_rows(spark, sf).groupBy("champion", "position").agg(
        F.sum(F.col("picks") + F.col("bans")).alias("presence"), F.sum("wins").alias("wins")
    )
    return rates.main_position_stats(s, "champion", "position", "presence", ["wins"])


@query(
    "prefer_observed",
    "SELECT p_partkey, CASE WHEN coalesce(p_size % 3, 0) <> 0 THEN CAST(p_size % 3 AS DOUBLE) ELSE p_retailprice END AS v FROM part",
)
def prefer_observed(spark, sf):
    p = I.table(spark, sf, "part").withColumn("obs", (F.col("p_size") % 3).cast("double"))
    return p.select("p_partkey", rates.prefer_obs("obs", "p_retailprice").alias("v"))
