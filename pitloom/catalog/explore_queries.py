"""Exploratory queries (family O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import inputs as I
from pitloom.catalog import query
from pitloom.catalog import rates_queries as RQ
from pitloom.catalog.inputs import with_inputs
from pitloom.functions.columns import parse_percent
from pitloom.operators import explore as E
from pitloom.operators import rates
from pitloom.operators import reshape as rs


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


_S = RQ.SEASON_SQL
_ST = (
    "SELECT {k}, CAST(sum(picks) AS BIGINT) AS picks, CAST(sum(bans) AS BIGINT) AS bans, CAST(sum(wins) AS BIGINT) AS wins, sum(picks) / (SELECT ceil(sum(picks) / 10.0) FROM s) AS pick_rate, "
    "sum(bans) / (SELECT ceil(sum(picks) / 10.0) FROM s) AS ban_rate, sum(wins) / nullif(sum(picks), 0) AS win_rate FROM s GROUP BY {k}"
)


def stats(spark, sf, keys=("champion",)):
    return rates.season_stats(RQ.season_rows(spark, sf), list(keys), ["picks", "bans", "wins"], ["dpm"])


@query("presence_table", f"WITH s AS ({_S}), t AS ({_ST.format(k='champion')}) SELECT champion, picks, bans, picks + bans AS total, round(pick_rate + ban_rate, 6) AS presence_rate, round(win_rate, 6) AS win_rate FROM t ORDER BY total DESC, champion LIMIT 15")
def presence_table(spark, sf):
    p = E.presence(stats(spark, sf))
    return p.select("champion", "picks", "bans", "total", r("presence_rate").alias("presence_rate"), r("win_rate").alias("win_rate"))


@query("top_by_position", f"WITH s AS ({_S}), t AS ({_ST.format(k='champion, position')}) SELECT * FROM (SELECT position, champion, picks, row_number() OVER (PARTITION BY position ORDER BY pick_rate DESC, champion) AS rank FROM t) WHERE rank <= 8")
def top_by_position(spark, sf):
    return E.top_by_position(stats(spark, sf, ("champion", "position"))).select("position", "champion", "picks", "rank")


@query(
    "outlier_lists",
    f"WITH s AS ({_S}), t AS ({_ST.format(k='champion')}) SELECT * FROM (SELECT champion, 'popular_weak' AS kind FROM t WHERE pick_rate > 0.4 AND win_rate < 0.335 ORDER BY win_rate, champion LIMIT 10) "
    "UNION ALL SELECT * FROM (SELECT champion, 'rare_strong' FROM t WHERE pick_rate <= 0.4 AND win_rate >= 0.335 ORDER BY win_rate DESC, champion LIMIT 10)",
)
def outlier_lists(spark, sf):
    return E.outliers(stats(spark, sf), 0.4, 0.335).select("champion", "kind")


@query(
    "top_pairs",
    with_inputs("SELECT * FROM (SELECT src, position, row_number() OVER (PARTITION BY position ORDER BY games DESC, src) AS rank FROM pairs) WHERE rank <= 10", "pairs"),
)
def top_pairs(spark, sf):
    return E.top_pairs(I.pairs(spark, sf), "position", "games", 10, ["src"]).select("src", "position", "rank")


_TOPV = ["C1", "C2", "C3", "C4", "C5"]


@query(
    "pair_heatmap",
    with_inputs(
        "SELECT champion, opponent_name, round(avg(w) * 100, 4) AS rate_pct FROM p WHERE champion IN (SELECT champion FROM p GROUP BY 1 ORDER BY sum(games) DESC, 1 LIMIT 10) "
        "AND opponent_name IN (SELECT opponent_name FROM p GROUP BY 1 ORDER BY sum(games) DESC, 1 LIMIT 10) GROUP BY 1, 2",
        "pairs",
        p=f"SELECT champion, opponent_name, games, {I.DUCK_PCT} AS w FROM pairs",
    ),
)
def pair_heatmap(spark, sf):
    p = I.pairs(spark, sf).withColumn("w", parse_percent("win_rate"))
    return E.heatmap_long(p, "champion", "opponent_name", "w", "games").withColumn("rate_pct", r("rate_pct", 4))


@query(
    "pair_heatmap_wide",
    with_inputs(
        "SELECT champion, " + ", ".join(f"round(avg(CASE WHEN opponent_name = '{c}' THEN w END) * 100, 4) AS {c}" for c in _TOPV) + " FROM p WHERE champion IN ('C1', 'C2', 'C3', 'C4', 'C5') AND opponent_name IN ('C1', 'C2', 'C3', 'C4', 'C5') GROUP BY 1",
        "pairs",
        p=f"SELECT champion, opponent_name, games, {I.DUCK_PCT} AS w FROM pairs",
    ),
)
def pair_heatmap_wide(spark, sf):
    p = I.pairs(spark, sf).withColumn("w", parse_percent("win_rate"))
    return E.pair_heatmap(p, "champion", "opponent_name", "w", "games", _TOPV)


@query(
    "daily_trend",
    with_inputs("SELECT day, champion, count(*) AS n FROM ban_rows WHERE champion IN (SELECT champion FROM ban_rows GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1, 2", "ban_rows"),
)
def daily_trend(spark, sf):
    return E.daily_trend(rs.melt_bans(I.games(spark, sf)), "champion", "day")


@query(
    "side_bans",
    with_inputs("SELECT * FROM (SELECT side, champion, count(*) AS n, row_number() OVER (PARTITION BY side ORDER BY count(*) DESC, champion) AS rank FROM ban_rows GROUP BY 1, 2) WHERE rank <= 10", "ban_rows"),
)
def side_bans(spark, sf):
    return E.side_top(rs.melt_bans(I.games(spark, sf)), "side", "champion")


@query("side_win_rate", with_inputs("SELECT side, round(avg(result), 6) AS rate, count(*) AS n FROM team_rows GROUP BY 1", "team_rows"))
def side_win_rate(spark, sf):
    return rates.group_rate(rs.melt_teams(I.games(spark, sf)), ["side"], "result").withColumn("rate", r("rate"))


@query(
    "core3_compositions",
    with_inputs("SELECT array_to_string(list_sort([blue_pick1, blue_pick2, blue_pick3]), '+') AS core, count(*) AS n, round(avg(result), 6) AS win_rate FROM games GROUP BY 1 HAVING count(*) > 1", "games"),
)
def core3_compositions(spark, sf):
    c = E.core3(I.games(spark, sf), [f"blue_pick{i}" for i in range(1, 6)], "result")
    return c.withColumn("win_rate", r("win_rate"))


def _sides(spark, sf):
    g = I.games(spark, sf)
    one = [
        F.struct(*[F.col(f"{s}_{p}_champion").alias(p) for p in rs.ROLES], (F.col("result") if s == "blue" else 1 - F.col("result")).alias("res"))
        for s in rs.SIDES
    ]
    return g.select("gameid", F.inline(F.array(*one)))


_SLOTS = [("top", "jng"), ("jng", "mid"), ("bot", "sup")]


@query(
    "best_duos",
    with_inputs(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY w DESC, n DESC, a, b) AS rank FROM (SELECT lane, a, b, count(*) AS n, avg(res) AS w FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 2)) WHERE rank <= 5",
        "games",
        d=" UNION ALL ".join(
            f"SELECT '{x}-{y}' AS lane, {s}_{x}_champion AS a, {s}_{y}_champion AS b, {'result' if s == 'blue' else '1 - result'} AS res FROM games" for x, y in _SLOTS for s in rs.SIDES
        ),
    ).replace("SELECT * FROM (SELECT *, row_number()", "SELECT lane, a, b, n, round(w, 6) AS win_rate, rank FROM (SELECT *, row_number()"),
)
def best_duos(spark, sf):
    return E.best_duos(_sides(spark, sf), _SLOTS, "res").withColumn("win_rate", r("win_rate"))


_TPL = with_inputs(
    "SELECT core, rank, champion, position, meta, synergy, counter, attributes, total FROM (SELECT *, row_number() OVER (PARTITION BY core ORDER BY total DESC, champion, position) AS rank FROM ("
    "SELECT *, round(meta + synergy + counter + attributes, 2) AS total FROM ("
    "SELECT o.core, s.champion, s.position, any_value(s.meta) AS meta, any_value(s.attr) AS attributes, "
    "round(least(sum(coalesce(y.v, 0)) / 3, 35.0), 2) AS synergy, round(least(sum(coalesce(e.v, 0)), 20.0), 2) AS counter "
    "FROM o JOIN s ON NOT list_contains(o.a, s.champion) AND NOT list_contains(o.homes, s.position) "
    "JOIN oc ON oc.core = o.core LEFT JOIN y ON y.a = s.champion AND y.b = oc.c LEFT JOIN e ON e.champion = s.champion AND e.opponent_name = oc.c GROUP BY 1, 2, 3))) WHERE rank <= 5",
    "player_rows",
    "pairs",
    c0="SELECT array_to_string(list_sort([blue_pick1, blue_pick2, blue_pick3]), '+') AS core, count(*) AS n FROM games GROUP BY 1 HAVING count(*) >= 2",
    oc="SELECT core, unnest(string_split(core, '+')) AS c FROM c0",
    p="SELECT champion, position, count(*) AS picks, avg(result) AS wr, avg((kills + assists) / greatest(deaths, 1)) AS kda FROM player_rows GROUP BY 1, 2",
    s=(
        "SELECT champion, position, picks, round(least(picks / (SELECT ceil(sum(picks) / 10.0) FROM p) * 75, 15.0) + least(wr * 30, 15.0) + least(0.1001 * 30, 5.0), 2) AS meta, "
        "round(least(kda, 4.0) + least(kda * 90 / 200, 3.0) + least(kda * 50 / 100, 3.0), 2) AS attr FROM p"
    ),
    hm="SELECT champion, arg_max(position, CAST(picks AS BIGINT) * 10 + CASE position WHEN 'top' THEN 5 WHEN 'sup' THEN 4 WHEN 'mid' THEN 3 WHEN 'jng' THEN 2 ELSE 1 END) AS pos FROM p GROUP BY 1",
    o="SELECT core, list(c) AS a, list(coalesce(hm.pos, '')) AS homes FROM oc LEFT JOIN hm ON hm.champion = oc.c GROUP BY 1",
    sy=RQ._synergy_sql(False),
    y0="SELECT champion_a AS a, champion_b AS b, win_rate AS w FROM sy UNION SELECT champion_b, champion_a, win_rate FROM sy",
    y="SELECT a, b, least(w * 100 / 10, 12.0) + least(w * 10, 5.0) AS v FROM y0",
    e=(
        f"SELECT champion, opponent_name, sum(3 + (1 - w) * 100 - 50) AS v FROM (SELECT *, {I.DUCK_PCT} AS w FROM pairs) WHERE w BETWEEN 0 AND 1 AND games > 0 AND matchup_type = 'easy' GROUP BY 1, 2"
    ),
)


@query("template_fill", _TPL)
def template_fill(spark, sf):
    cores = E.core3(I.games(spark, sf), [f"blue_pick{i}" for i in range(1, 6)], "result")
    cores = cores.select(F.split("core", r"\+").alias("core"))
    p = I.player_rows(spark, sf).groupBy("champion", "position").agg(
        F.count("*").alias("picks"), F.avg("result").alias("win_rate"), F.avg((F.col("kills") + F.col("assists")) / F.greatest("deaths", F.lit(1))).alias("kda")
    )
    games = p.agg(F.ceil(F.sum("picks") / 10)).scalar()
    st = p.withColumns({"pick_rate": F.col("picks") / games, "ban_rate": F.lit(0.1001), "dpm": F.col("kda") * 90, "gpm": F.col("kda") * 50})
    c = RQ.clean_pairs(spark, sf)
    syn = rates.synergy_lookup(c)
    both = syn.select(F.col("champion_a").alias("a"), F.col("champion_b").alias("b"), "win_rate").union(syn.select("champion_b", "champion_a", "win_rate")).distinct()
    ctr = c.withColumn("opponent_win_rate", 1 - F.col("win_rate"))
    return E.template_fill(cores, st, both.withColumn("score", F.col("win_rate") * 100), ctr)


def _season(spark, sf, lo, hi):
    s = RQ.season_rows(spark, sf).filter(F.col("season").between(lo, hi))
    return s.groupBy("champion").agg(F.sum("picks").alias("picks"))


def _sq(lo, hi):
    return f"SELECT champion, CAST(sum(picks) AS BIGINT) AS picks FROM s WHERE season BETWEEN {lo} AND {hi} GROUP BY 1"


_CMP = "SELECT coalesce(x.champion, y.champion) AS champion, coalesce(x.picks, 0) AS picks_before, coalesce(y.picks, 0) AS picks_after, coalesce(y.picks, 0) - coalesce(x.picks, 0) AS picks_change FROM x FULL JOIN y ON x.champion = y.champion"


@query(
    "split_change",
    f"WITH s AS ({_S}), x AS ({_sq(1995, 1997)}), y AS ({_sq(1998, 2001)}), c AS ({_CMP}) SELECT * FROM (SELECT *, 'riser' AS kind FROM c WHERE picks_change > 0 ORDER BY picks_change DESC, champion LIMIT 5) "
    "UNION ALL SELECT * FROM (SELECT *, 'faller' AS kind FROM c WHERE picks_change < 0 ORDER BY picks_change, champion LIMIT 5)",
)
def split_change(spark, sf):
    return E.split_change(_season(spark, sf, 1995, 1997), _season(spark, sf, 1998, 2001), "champion", "picks")


@query(
    "counters_top",
    with_inputs(
        "SELECT * FROM (SELECT src, champion, row_number() OVER (PARTITION BY champion, matchup_type ORDER BY CASE WHEN matchup_type = 'hard' THEN w ELSE -w END, opponent_name, src) AS rank FROM p "
        "WHERE champion IN (SELECT champion FROM p GROUP BY 1 ORDER BY sum(games) DESC, 1 LIMIT 10)) WHERE rank <= 3",
        "pairs",
        p=f"SELECT * FROM (SELECT src, champion, opponent_name, games, matchup_type, {I.DUCK_PCT} AS w FROM pairs) WHERE w IS NOT NULL",
    ),
)
def counters_top(spark, sf):
    p = I.pairs(spark, sf).withColumn("win_rate", parse_percent("win_rate")).filter("win_rate is not null")
    top = p.groupBy("champion").agg(F.sum("games").alias("g")).orderBy(F.col("g").desc(), "champion").limit(10)
    return E.counters_top(p, top).select("src", "champion", "rank")


@query(
    "group_diff",
    f"WITH s AS ({_S}), x AS ({_sq(1995, 1997)}), y AS ({_sq(1998, 2001)}), c AS ({_CMP}) SELECT champion, picks_before, picks_after, picks_change FROM (SELECT *, rank() OVER (ORDER BY abs(picks_change) DESC) AS rk FROM c WHERE (picks_before + picks_after) / 2.0 > 2) WHERE rk <= 10",
)
def group_diff(spark, sf):
    return E.group_diff(_season(spark, sf, 1995, 1997), _season(spark, sf, 1998, 2001), "champion", "picks", 2)


@query(
    "summary_facts",
    with_inputs("SELECT count(*) AS games, round(avg(result), 6) AS blue_win_rate, round(avg(gamelength), 4) AS mean_length, (SELECT count(DISTINCT champion) FROM player_rows) AS champions FROM games", "player_rows"),
)
def summary_facts(spark, sf):
    s = E.summary(I.games(spark, sf).select("result", "gamelength"), I.player_rows(spark, sf))
    return s.withColumns({"blue_win_rate": r("blue_win_rate"), "mean_length": r("mean_length", 4)})
