"""Match-shaped inputs derived from the supplied tables.

Each input is a list of plain SQL expressions over a supplied table, so that
the Spark plans and the reference SQL start from the same rows. Work grows
with the tables: one order is one game, one line item is one pick, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.functions.columns import micros

ROLES = ["top", "jng", "mid", "bot", "sup"]
SIDES = ["blue", "red"]
N_TEAMS = 40
N_CHAMPS = 41


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(e):
    return f"CAST(floor({e}) AS BIGINT)"


_V = _int("o_totalprice")
_BT = f"(o_custkey % {N_TEAMS})"
_RT = f"((o_custkey + 1 + o_orderkey % {N_TEAMS - 1}) % {N_TEAMS})"
_TEAM = {"blue": _BT, "red": _RT}


def _champ(idx):
    return f"('C' || CAST({idx} AS STRING))"


def game_exprs() -> dict[str, str]:
    e = {
        "gameid": "o_orderkey",
        "league": "CASE o_custkey % 4 WHEN 0 THEN 'LPL' WHEN 1 THEN 'LCK' WHEN 2 THEN 'LEC' ELSE 'LCS' END",
        "blue_team": f"'T' || CAST({_BT} AS STRING)",
        "red_team": f"'T' || CAST({_RT} AS STRING)",
        "result": f"CAST({_V} % 2 AS INT)",
        "playoffs": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS INT) END",
        "first_pick_map_side": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 2 AS INT) END",
        "game_num": "CAST(1 + o_orderkey % 5 AS INT)",
        "gamelength": "CAST(1500 + (o_orderkey * 37) % 1200 AS DOUBLE)",
        "ckpm": "CAST(40 + o_orderkey % 60 AS DOUBLE) / 100",
        "prev_game_champs": (
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE "
            f"{_champ(f'(o_orderkey * 3) % {N_CHAMPS}')} || '| ' || {_champ(f'(o_orderkey * 5 + 1) % {N_CHAMPS}')} END"
        ),
    }
    for s, off in (("blue", 0), ("red", 1)):
        sign = "" if s == "blue" else "-"
        t = _TEAM[s]
        e[f"{s}_golddiffat15"] = (
            f"CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0.0 "
            f"ELSE CAST({sign}((o_orderkey * 53) % 4001 - 2000) AS DOUBLE) END"
        )
        e[f"{s}_firstdragon"] = f"CAST(({_V} + {off}) % 2 AS INT)"
        e[f"{s}_firsttower"] = f"CAST((o_orderkey + {off}) % 2 AS INT)"
        for i in range(1, 6):
            idx = f"((o_orderkey * 7 + o_custkey * 3 + {i * 2 + off}) % {N_CHAMPS})"
            e[f"{s}_ban{i}"] = (
                f"CASE WHEN (o_orderkey + {i}) % 23 = 0 THEN '' WHEN (o_orderkey + {i}) % 29 = 0 THEN 'Unknown' "
                f"WHEN (o_orderkey + {i}) % 31 = 0 THEN NULL ELSE {_champ(idx)} END"
            )
        for p, role in enumerate(ROLES):
            sub = f"CASE WHEN o_orderkey % 6 = 0 THEN 5 ELSE {p} END" if p == 0 else str(p)
            e[f"{s}_{role}_player_id"] = f"'P' || CAST({t} * 6 + {sub} AS STRING)"
            champ = _champ(f"({t} * 7 + {p * 9} + (o_orderkey % 4) * {p + 1}) % {N_CHAMPS}")
            e[f"{s}_{role}_champion"] = champ
            e[f"{s}_pick{p + 1}"] = champ
            e[f"{s}_{role}_kills"] = f"CAST(({_V} + {p * 7 + off}) % 12 AS INT)"
            e[f"{s}_{role}_deaths"] = f"CAST(({_int('o_totalprice / 3')} + {p * 5 + off}) % 6 AS INT)"
            e[f"{s}_{role}_assists"] = f"CAST(({_int('o_totalprice / 7')} + {p * 3 + off}) % 15 AS INT)"
    return e


# patch of a game: year and quarter of its date; every tenth game is still on the previous one
SPARK_PATCH = (
    "CASE WHEN o_orderkey % 997 = 0 THEN 'beta' ELSE concat(cast(year(o_orderdate) - 1981 as string), '.', "
    "cast(quarter(o_orderdate) - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END as string)) END"
)
DUCK_PATCH = SPARK_PATCH

GAME = game_exprs()
GAMES_SQL = (
    "SELECT o_orderdate AS date, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, "
    + f"{DUCK_PATCH} AS patch, "
    + ", ".join(f"{v} AS {k}" for k, v in GAME.items())
    + " FROM orders"
)


_WHEN = (
    "CAST(o_orderdate AS TIMESTAMP) AS date",
    "unix_date(CAST(o_orderdate AS DATE)) AS day",
    f"{SPARK_PATCH} AS patch",
)


def staged_stream(spark: SparkSession, df: DataFrame, when: str, parts: int = 4) -> tuple[DataFrame, str]:
    """The rows of `df` as a file stream with late rows, and the delay within which they come.

    The span of the column `when` is cut into `parts`, written one after the other; a fifth of the rows of a part come with the
    next one. A last row far ahead lets the watermark pass all others; the stateful operators never emit it.
    """
    import uuid

    from pitloom.streaming.jobs import checkpoint_root

    us = F.unix_micros(F.col(when).cast("timestamp"))
    low, high = df.agg(F.min(us), F.max(us)).first()
    low, high = low or 0, high or 0
    width = (high - low) // parts + 1
    part = F.floor((us - low) / width) + (F.pmod(F.xxhash64(*df.columns), F.lit(5)) == 0).cast("int")
    path = f"{checkpoint_root(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    for k in range(parts + 1):
        df.filter(part == k).write.mode("append").parquet(path)
    delay = 2 * width // 1_000_000 + 1
    far = F.timestamp_seconds(F.lit((high + 4 * width) // 1_000_000 + 400 * 86_400))
    blank = lambda f: F.lit(-1).cast(f.dataType) if f.dataType.typeName() not in ("string", "timestamp", "date", "boolean", "timestamp_ntz") else F.lit(None).cast(f.dataType)
    end = spark.range(1).select(*(far.cast(f.dataType).alias(f.name) if f.name == when else blank(f).alias(f.name) for f in df.schema))
    end.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path), f"{delay} seconds"


def games(spark, sf_dir, orders: DataFrame | None = None) -> DataFrame:
    """Wide match table: one row per order."""
    return (table(spark, sf_dir, "orders") if orders is None else orders).selectExpr(
        *_WHEN, *[f"{v} AS {k}" for k, v in GAME.items()]
    )


def _slot(blue: str, red: str) -> str:
    return f"CASE WHEN s = 0 THEN {blue} ELSE {red} END"


def player_rows(spark, sf_dir) -> DataFrame:
    """The melted player rows, computed per slot instead of per wide column."""
    o = table(spark, sf_dir, "orders").selectExpr(
        *_WHEN, "o_orderkey", "o_totalprice", f"{GAME['league']} AS league", f"{GAME['result']} AS r",
        f"{_V} AS v", f"{_BT} AS bt", f"{_RT} AS rt",
    )
    slots = o.selectExpr("*", "explode(sequence(0, 9)) AS slot").selectExpr("*", "slot % 5 AS p", "slot div 5 AS s")
    slots = slots.selectExpr("*", f"{_slot('bt', 'rt')} AS t")
    return slots.selectExpr(
        "o_orderkey AS gameid",
        "date",
        "day",
        "patch",
        "league",
        "CASE WHEN s = 0 THEN 'blue' ELSE 'red' END AS side",
        "'T' || CAST(t AS STRING) AS team",
        "element_at(array('top', 'jng', 'mid', 'bot', 'sup'), CAST(p + 1 AS INT)) AS position",
        "'P' || CAST(t * 6 + CASE WHEN p = 0 AND o_orderkey % 6 = 0 THEN 5 ELSE p END AS STRING) AS player_id",
        f"'C' || CAST((t * 7 + p * 9 + (o_orderkey % 4) * (p + 1)) % {N_CHAMPS} AS STRING) AS champion",
        f"{_slot('r', '1 - r')} AS result",
        "CAST((v + p * 7 + s) % 12 AS INT) AS kills",
        "CAST((CAST(floor(o_totalprice / 3) AS BIGINT) + p * 5 + s) % 6 AS INT) AS deaths",
        "CAST((CAST(floor(o_totalprice / 7) AS BIGINT) + p * 3 + s) % 15 AS INT) AS assists",
    )


def _union(parts):
    return " UNION ALL ".join(parts)


PLAYER_ROWS_SQL = _union(
    f"SELECT gameid, date, day, patch, league, '{s}' AS side, {s}_team AS team, '{r}' AS position, "
    f"{s}_{r}_player_id AS player_id, {s}_{r}_champion AS champion, "
    f"{'result' if s == 'blue' else '1 - result'} AS result, {s}_{r}_kills AS kills, "
    f"{s}_{r}_deaths AS deaths, {s}_{r}_assists AS assists FROM games"
    for s in SIDES
    for r in ROLES
)
BAN_ROWS_SQL = (
    "SELECT * FROM ("
    + _union(
        f"SELECT gameid, date, day, patch, '{s}' AS side, {s}_team AS team, "
        f"{'red' if s == 'blue' else 'blue'}_team AS opponent, {i} AS slot, trim({s}_ban{i}) AS champion FROM games"
        for s in SIDES
        for i in range(1, 6)
    )
    + ") WHERE champion IS NOT NULL AND champion <> '' AND champion <> 'Unknown'"
)


def _sum(s, stat):
    return "(" + " + ".join(f"{s}_{r}_{stat}" for r in ROLES) + ")"


TEAM_ROWS_SQL = _union(
    f"SELECT gameid, date, day, '{s}' AS side, {s}_team AS team, {'red' if s == 'blue' else 'blue'}_team AS opponent, "
    f"{'result' if s == 'blue' else '1 - result'} AS result, gamelength, ckpm, "
    f"nullif({s}_golddiffat15, 0) AS golddiffat15, {s}_firstdragon AS firstdragon, {s}_firsttower AS firsttower, "
    f"{_sum(s, 'kills')} AS total_kills, {_sum(s, 'deaths')} AS total_deaths, {_sum(s, 'assists')} AS total_assists, "
    f"({_sum(s, 'kills')} + {_sum(s, 'assists')}) / (gamelength / 60) AS bloodiness, "
    f"CASE WHEN {s}_golddiffat15 > 500 THEN 1 ELSE 0 END AS led_at_15, "
    f"CASE WHEN {s}_golddiffat15 > 500 AND {'result' if s == 'blue' else '1 - result'} = 1 THEN 1 ELSE 0 END AS snowball_win "
    "FROM games"
    for s in SIDES
)

CAREER = {
    "player_id": f"'P' || CAST(c_custkey % {N_TEAMS * 6} AS STRING)",
    "champion": _champ(f"(c_custkey * 11) % {N_CHAMPS}"),
    "games": "CAST(5 + c_custkey % 60 AS INT)",
    "win_rate": "0.3 + CAST(c_nationkey % 25 AS DOUBLE) / 50",
    "kda": "1.0 + CAST(c_custkey % 70 AS DOUBLE) / 10",
    "src": "c_custkey",
}
CAREER_SQL = (
    "SELECT player_id, champion, arg_min(games, src) AS games, arg_min(win_rate, src) AS win_rate, "
    "arg_min(kda, src) AS kda FROM (SELECT "
    + ", ".join(f"{v} AS {k}" for k, v in CAREER.items())
    + " FROM customer) GROUP BY 1, 2"
)


def career(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(*[F.expr(v).alias(k) for k, v in CAREER.items()])
    return c.groupBy("player_id", "champion").agg(
        *[F.min_by(x, "src").alias(x) for x in ("games", "win_rate", "kda")]
    )


_PA = f"p_partkey % {N_CHAMPS}"
_PB = f"CAST(floor(p_partkey / {N_CHAMPS}) AS BIGINT) % {N_CHAMPS}"
PAIRS = {
    "champion": _champ(_PA),
    "opponent_name": _champ(_PB),
    "position": "CASE p_partkey % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'jng' WHEN 2 THEN 'mid' WHEN 3 THEN 'bot' ELSE 'sup' END",
    "games": "CAST(p_size - 2 AS INT)",
    "win_rate": (
        "CASE WHEN p_partkey % 37 = 0 THEN 'n/a' WHEN p_partkey % 3 = 0 THEN "
        "CAST(30 + (p_partkey * 17) % 41 AS STRING) || '%' ELSE "
        "'0.' || CAST(30 + (p_partkey * 13) % 41 AS STRING) END"
    ),
    "matchup_type": "CASE WHEN (p_partkey * 17) % 2 = 0 THEN 'hard' ELSE 'easy' END",
    "src": "p_partkey",
}
PAIRS_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in PAIRS.items()) + " FROM part"


def pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(*[F.expr(v).alias(k) for k, v in PAIRS.items()])


# percent text -> fraction, written once more for the reference SQL
DUCK_PCT = (
    "CASE WHEN try_cast(replace(win_rate, '%', '') AS DOUBLE) > 1 THEN try_cast(replace(win_rate, '%', '') AS DOUBLE) / 100 "
    "ELSE try_cast(replace(win_rate, '%', '') AS DOUBLE) END"
)

# vocabulary: all champions that appear in a pair
VOCAB_SQL = "SELECT champion, CAST(substr(champion, 2) AS BIGINT) + 7 AS idx FROM (SELECT DISTINCT champion FROM pairs)"


def vocab(spark, sf_dir) -> DataFrame:
    names = pairs(spark, sf_dir).select("champion").distinct()
    n = F.substring("champion", 2, 9).cast("long")
    return names.select("champion", (n + 7).alias("idx"))


# share of a champion's parts per type bucket = position prior
PRIOR_SQL = (
    "SELECT champion, "
    + ", ".join(
        f"CAST(sum(CASE WHEN (src + CAST(floor(src / 41) AS BIGINT) * (src % 3)) % 5 = {i} THEN games + 2 ELSE 0 END) AS DOUBLE) / "
        f"sum(games + 2) AS pos_{r}"
        for i, r in enumerate(ROLES)
    )
    + " FROM pairs GROUP BY champion"
)


def position_prior(spark, sf_dir) -> DataFrame:
    p = pairs(spark, sf_dir)
    slot = "(src + CAST(floor(src / 41) AS BIGINT) * (src % 3)) % 5"
    return p.groupBy("champion").agg(
        *[
            (
                F.sum(F.expr(f"CASE WHEN {slot} = {i} THEN games + 2 ELSE 0 END")).cast("double")
                / F.sum(F.col("games") + 2)
            ).alias(f"pos_{r}")
            for i, r in enumerate(ROLES)
        ]
    )


TAGS = ["engage", "poke", "peel", "burst", "tank", "hardcc", "linestrength"]
TAGS_SQL = (
    "SELECT champion, "
    + ", ".join(f"CASE WHEN CAST(substr(champion, 2) AS BIGINT) % 10 <> 3 THEN CAST(sum(src * {i + 3}) % 4 AS INT) END AS {t}" for i, t in enumerate(TAGS))
    + " FROM pairs GROUP BY champion"
)


def tags(spark, sf_dir) -> DataFrame:
    known = F.substring("champion", 2, 9).cast("long") % 10 != 3  # the others have no tags
    return pairs(spark, sf_dir).groupBy("champion").agg(
        *[F.when(known, (F.sum(F.col("src") * (i + 3)) % 4).cast("int")).alias(t) for i, t in enumerate(TAGS)]
    )


# ranking rows: query = supplier, candidate = part; integer sums keep scores identical across engines
SCORES = (
    "SELECT l_suppkey AS query_id, l_partkey AS candidate_id, "
    "CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 10 - 2.5 AS cs_logit, "
    "CAST(sum(CAST(l_extendedprice AS BIGINT) % 1000) AS DOUBLE) / count(*) / 200 - 2.5 AS nocs_logit, "
    "CAST(max(CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS label, "
    "CAST(max(CASE WHEN l_tax < 0.075 THEN 1 ELSE 0 END) AS INT) AS mask "
    "FROM lineitem GROUP BY l_suppkey, l_partkey"
)


def scores(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = F.count("*")
    return li.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("candidate_id")).agg(
        (F.sum(F.col("l_quantity").cast("long")).cast("double") / n / 10 - 2.5).alias("cs_logit"),
        (F.sum(F.expr("CAST(round(l_extendedprice) AS BIGINT) % 1000")).cast("double") / n / 200 - 2.5).alias("nocs_logit"),
        F.max(F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), 1).otherwise(0)).alias("label"),
        F.max(F.when(F.col("l_tax") < 0.075, 1).otherwise(0)).alias("mask"),
    )


SCORES_SQL = SCORES.replace("CAST(l_extendedprice AS BIGINT)", "CAST(round(l_extendedprice) AS BIGINT)")

# probability rows: label = value above 30, p from the order of arrival, segment = event type
PREDS_SQL = (
    "SELECT event_id AS row_id, event_type AS segment, CAST(CASE WHEN value > 30 THEN 1 ELSE 0 END AS INT) AS y, "
    "CAST((event_id * 7919 + CASE WHEN value > 30 THEN 120 ELSE 0 END) % 1000 AS DOUBLE) / 1000 AS p, "
    "event_id % 5 AS fold FROM events"
)


def preds(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("segment"),
        F.when(F.col("value") > 30, 1).otherwise(0).alias("y"),
        F.expr("CAST((event_id * 7919 + CASE WHEN value > 30 THEN 120 ELSE 0 END) % 1000 AS DOUBLE) / 1000").alias("p"),
        F.expr("event_id % 5").alias("fold"),
    )


EV_SQL = (
    "SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, value, "
    "CAST(CASE WHEN value > 30 THEN 1 ELSE 0 END AS INT) AS result FROM events"
)


def ev(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events") if events is None else events
    return e.select(
        "event_id",
        "user_id",
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        micros("ts").alias("us"),
        "value",
        F.when(F.col("value") > 30, 1).otherwise(0).alias("result"),
    )


CTES = {
    "games": (GAMES_SQL, ()),
    "player_rows": (PLAYER_ROWS_SQL, ("games",)),
    "ban_rows": (BAN_ROWS_SQL, ("games",)),
    "team_rows": (TEAM_ROWS_SQL, ("games",)),
    "career": (CAREER_SQL, ()),
    "pairs": (PAIRS_SQL, ()),
    "vocab": (VOCAB_SQL, ("pairs",)),
    "prior": (PRIOR_SQL, ("pairs",)),
    "tags": (TAGS_SQL, ("pairs",)),
    "scores": (SCORES_SQL, ()),
    "preds": (PREDS_SQL, ()),
    "ev": (EV_SQL, ()),
}


def with_inputs(sql: str, *names: str, **extra: str) -> str:
    """Prefix a query with the inputs it reads (and what those read)."""
    done: list[str] = []

    def add(n):
        for dep in CTES[n][1]:
            add(dep)
        if n not in done:
            done.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][0]})" for n in done] + [f"{k} AS ({v})" for k, v in extra.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
