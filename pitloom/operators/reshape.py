"""Projection, filter and reshape operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.columns import col, finite_or

SIDES = ("blue", "red")
ROLES = ("top", "jng", "mid", "bot", "sup")
STATS = ("kills", "deaths", "assists")


def _unfold(df: DataFrame, keep: list[str], structs: list[Column]) -> DataFrame:
    """One pass: each row becomes one row per struct."""
    return df.select(*keep, F.inline(F.array(*structs)))


def _side_result(side: str) -> Column:
    return F.col("result") if side == "blue" else 1 - F.col("result")


def enforce_pit(df: DataFrame, result_cols: list[str], keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(pre-game columns, post-game columns); a result column that is absent becomes null."""
    features = df.select(*[c for c in df.columns if c not in result_cols])
    results = df.select(
        *keep, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in result_cols]
    )
    return features, results


def melt_players(df: DataFrame, extra: tuple[str, ...] = ("league",)) -> DataFrame:
    """Ten player rows per game; the result is seen from the player's side."""
    structs = [
        F.struct(
            F.lit(s).alias("side"),
            F.col(f"{s}_team").alias("team"),
            F.lit(p).alias("position"),
            F.col(f"{s}_{p}_player_id").alias("player_id"),
            F.col(f"{s}_{p}_champion").alias("champion"),
            _side_result(s).alias("result"),
            *[F.col(f"{s}_{p}_{x}").alias(x) for x in STATS],
        )
        for s in SIDES
        for p in ROLES
    ]
    keep = [c for c in ("gameid", "date", "day", "patch", *extra) if c in df.columns]
    return _unfold(df, keep, structs)


def melt_bans(df: DataFrame) -> DataFrame:
    """Up to ten ban rows per game; empty and unknown bans are dropped."""
    structs = [
        F.struct(
            F.lit(s).alias("side"),
            F.col(f"{s}_team").alias("team"),
            F.col(f"{'red' if s == 'blue' else 'blue'}_team").alias("opponent"),
            F.lit(i).alias("slot"),
            F.trim(f"{s}_ban{i}").alias("champion"),
        )
        for s in SIDES
        for i in range(1, 6)
    ]
    keep = [c for c in ("gameid", "date", "day", "patch") if c in df.columns]
    rows = _unfold(df, keep, structs)
    return rows.filter(F.col("champion").isNotNull() & ~F.col("champion").isin("", "Unknown"))


def melt_teams(df: DataFrame, lead: float = 500.0) -> DataFrame:
    """Two team rows per game with kill, death and assist totals and lead flags."""

    def one(s):
        tot = {x: sum((F.col(f"{s}_{p}_{x}") for p in ROLES[1:]), F.col(f"{s}_{ROLES[0]}_{x}")) for x in STATS}
        gold, minutes = F.col(f"{s}_golddiffat15"), F.col("gamelength") / 60
        led = F.coalesce(gold > lead, F.lit(False))
        res = _side_result(s)
        return F.struct(
            F.lit(s).alias("side"),
            F.col(f"{s}_team").alias("team"),
            F.col(f"{'red' if s == 'blue' else 'blue'}_team").alias("opponent"),
            res.alias("result"),
            F.col("gamelength"),
            F.col("ckpm"),
            null_if_zero(gold).alias("golddiffat15"),
            F.col(f"{s}_firstdragon").alias("firstdragon"),
            F.col(f"{s}_firsttower").alias("firsttower"),
            tot["kills"].alias("total_kills"),
            tot["deaths"].alias("total_deaths"),
            tot["assists"].alias("total_assists"),
            F.when(minutes > 0, F.try_divide(tot["kills"] + tot["assists"], minutes)).otherwise(0.0).alias("bloodiness"),
            led.cast("int").alias("led_at_15"),
            (led & (res == 1)).cast("int").alias("snowball_win"),
        )

    keep = [c for c in ("gameid", "date", "day") if c in df.columns]
    return _unfold(df, keep, [one(s) for s in SIDES])


def null_if_zero(c) -> Column:
    return F.when(col(c) != 0, col(c))


def drop_unknown_players(df: DataFrame, ids: list[str], known: DataFrame, key: str = "player_id") -> DataFrame:
    """Keep rows whose players are all in `known` (one anti join over the unfolded ids)."""
    named = df.select("gameid", F.explode(F.array(*ids)).alias(key))
    bad = named.join(known.select(key).distinct(), key, "left_anti").select("gameid").distinct()
    return df.join(bad, "gameid", "left_anti")


def one_hot(df: DataFrame, column: str, values: list[str], prefix: str | None = None) -> DataFrame:
    pre = f"{column}_" if prefix is None else prefix
    return df.withColumns({f"{pre}{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def one_hot_game(df: DataFrame, column: str = "game_num", n: int = 5) -> DataFrame:
    return df.withColumns({f"is_game_{i}": F.coalesce((F.col(column) == i).cast("int"), F.lit(0)) for i in range(1, n + 1)})


def game_num_from_onehot(n: int = 5) -> Column:
    """Number of the first flag that is set, 1 when none is."""
    flags = F.array(*[F.col(f"is_game_{i}") for i in range(1, n + 1)])
    pos = F.array_position(flags, 1)
    return F.when(pos > 0, pos).otherwise(1).cast("int")


def normalise_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "first_pick_map_side": F.coalesce("first_pick_map_side", F.lit(1)),
            "playoffs": F.coalesce("playoffs", F.lit(0)),
        }
    ).withColumnsRenamed({"first_pick_map_side": "is_blue_map_side", "playoffs": "is_playoff"})


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Nulls become the default whose key the column name contains (longest key first)."""
    keys = sorted(defaults, key=len, reverse=True)
    fill = {}
    for c in df.columns:
        k = next((k for k in keys if k in c), None)
        if k is not None:
            fill[c] = defaults[k]
    return df.fillna(fill) if fill else df


def finite_columns(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: finite_or(c, value) for c in cols})


def feature_columns(df: DataFrame, exclude: set[str] = frozenset(), prefixes: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns minus labels, keys and unwanted prefixes; reads the schema only."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not f.name.startswith(tuple(prefixes) or ("\0",))
    ]


# Column-name parts that belong to the draft.
DRAFT_KEYWORDS = (
    "champion",
    "comp_",
    "mastery",
    "meta_win_rate_pit",
    "meta_patch_drift",
    "meta_pick_drift",
    "champ_",
)


def classify_columns(cols: list[str], keywords=DRAFT_KEYWORDS) -> tuple[list[str], list[str]]:
    """(draft columns, hard columns) by name."""
    draft = [c for c in cols if any(k in c for k in keywords)]
    return draft, [c for c in cols if c not in draft]


def predraft(df: DataFrame, cols: list[str], keywords=DRAFT_KEYWORDS) -> DataFrame:
    """The same rows as if nothing had been drafted: draft columns are 0."""
    draft, _ = classify_columns(cols, keywords)
    return df.withColumns({c: F.lit(0.0) for c in draft}) if draft else df


def align_columns(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in cols])


def drop_redundant(df: DataFrame, patterns: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if any(re.search(p, c) for p in patterns)])


def valid_pairs(df: DataFrame, a="champion", b="opponent_name", games="games", rate="win_rate") -> DataFrame:
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(rate).isNotNull() & F.col(games).isNotNull()
    return df.filter(ok & (F.col(games) > 0) & F.col(rate).between(0, 1))


#: Length of the letter groups by which names are found that contain each other.
_GRAM = 3


def _grams(c: Column, shortest: int = _GRAM) -> Column:
    """All different groups of `shortest` to _GRAM letters, and the whole of a name that is shorter."""
    size = F.length(c)
    parts = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array(c))
    return F.array_distinct(F.concat(*[parts(n) for n in range(shortest, _GRAM + 1)]))


def _containing(open_: DataFrame, known: DataFrame) -> DataFrame:
    """_n, best (length and name) for the open names (_n, _k) that contain a known one (_t, in lower case) or lie inside one.

    Both ways go over an index of letter groups and an equi join. A name of up to three letters is a group itself, whose best name
    is looked up; a longer one is sought by its rarest group, and so is every known name in the open ones.
    """
    best = F.min(F.struct(F.length("team").alias("l"), F.col("team").alias("t"))).alias("best")
    index = known.select("team", "_t", F.explode(_grams(F.col("_t"), 1)).alias("_g"))
    often = index.groupBy("_g").agg(F.count("*").alias("_often"), best)
    short = open_.filter(F.length("_k") <= _GRAM).join(often, F.col("_k") == F.col("_g")).select("_n", "best")
    rarest = F.min_by("_g", F.struct(F.coalesce("_often", F.lit(0)), "_g")).alias("_g")
    long = open_.filter(F.length("_k") > _GRAM)
    key = long.select("_n", "_k", F.explode(_grams(F.col("_k"))).alias("_g")).join(often.select("_g", "_often"), "_g", "left").groupBy("_n", "_k").agg(rarest)
    inside = key.join(index, "_g").filter(F.contains("_t", "_k")).groupBy("_n").agg(best)
    key = known.select("team", "_t", F.explode(_grams(F.col("_t"))).alias("_g")).join(often.select("_g", "_often"), "_g").groupBy("team", "_t").agg(rarest)
    around = open_.select("_n", "_k", F.explode(_grams(F.col("_k"), 1)).alias("_g")).join(key, "_g").filter(F.contains("_k", "_t")).groupBy("_n").agg(best)
    return short.union(inside).union(around).groupBy("_n").agg(F.min("best").alias("best"))


def resolve_names(df: DataFrame, name: str, known: DataFrame, alias: DataFrame, out: str = "resolved") -> DataFrame:
    """Exact match, else alias table, else a known name that contains the name or lies inside it.

    known: (team); alias: (alias, team). The containment test ignores case; the
    shortest, then first name wins; a known name without letters is in no name.
    It runs once per distinct open name.
    """
    raw = df.select(F.col(name).alias("_n")).distinct()
    teams = known.filter(F.col("team") != "").select("team").distinct()
    named = alias.groupBy(F.lower(F.trim("alias")).alias("_k")).agg(F.min("team").alias("_alias"))
    names = raw.join(teams.select(F.col("team").alias("_n"), F.col("team").alias("_exact")), "_n", "left").withColumn("_k", F.lower(F.trim("_n"))).join(named, "_k", "left")
    open_ = names.filter(F.col("_exact").isNull() & F.col("_alias").isNull() & (F.col("_k") != "")).select("_n", "_k")
    hits = _containing(open_, teams.withColumn("_t", F.lower("team")))
    found = names.join(hits, "_n", "left").select("_n", F.coalesce("_exact", "_alias", "best.t").alias(out))
    return df.join(found, F.col(name).eqNullSafe(F.col("_n")), "left").drop("_n")


def resolve_prefix(df: DataFrame, text: str, lookup: DataFrame, out: str = "idx") -> DataFrame:
    """Exact lower-case match, else the single entry that starts with the text.

    lookup: (name, idx). All prefixes of the lookup names are listed once and
    kept where only one entry has them, so both steps are plain equi joins.
    """
    key = F.lower(F.trim(text))
    names = lookup.select(F.lower(F.trim("name")).alias("name"), "idx").distinct()
    exact = names.groupBy("name").agg(F.min("idx").alias("_exact"))
    lens = F.sequence(F.lit(1), F.length("name"))
    prefixes = names.filter(F.length("name") > 0).select(F.explode(lens).alias("_l"), "name", "idx")
    single = (
        prefixes.groupBy(F.expr("substring(name, 1, _l)").alias("_p"))
        .agg(F.count_distinct("idx").alias("_c"), F.min("idx").alias("_prefix"))
        .filter("_c = 1")
    )
    out_df = df.withColumn("_k", key).join(exact, F.col("_k") == F.col("name"), "left").drop("name")
    out_df = out_df.join(single.drop("_c"), F.col("_k") == F.col("_p"), "left")
    return out_df.withColumn(out, F.coalesce("_exact", "_prefix")).drop("_k", "_exact", "_prefix", "_p")


def validate_requests(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Array of the messages of all broken rules (message -> condition that must not hold)."""
    found = F.array(*[F.when(cond, F.lit(msg)) for msg, cond in rules.items()])
    return df.withColumn("violations", F.filter(found, lambda m: m.isNotNull()))


def recommendation_rules(max_step: int = 20) -> dict[str, Column]:
    """Rules for a draft recommendation request (see FIXTURES 7)."""
    step, seq = F.col("completed_steps"), F.col("bp_seq_ids")
    rules = {
        "step_missing": step.isNull(),
        "step_range": (step < 0) | (step >= max_step),
        "sequence_length": F.size(seq) != step,
        "team_missing": (F.coalesce(F.trim("blue_team"), F.lit("")) == "") | (F.coalesce(F.trim("red_team"), F.lit("")) == ""),
        "game_num_range": ~F.col("game_num").between(1, 5),
    }
    for s in SIDES:
        pids = F.col(f"{s}_pids")
        unknown = F.filter(pids, lambda p: F.lower(F.trim(p)).isin("unknown", ""))
        rules[f"{s}_players_length"] = F.size(pids) != 5
        rules[f"{s}_unknown_players"] = F.size(unknown) > 2
    return rules


def normalise_player_id(c) -> Column:
    """Placeholders for a missing player become null."""
    x = F.trim(col(c))
    return F.when(~F.lower(x).isin("unknown", "", "nan", "none", "null"), x)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def top_n(df: DataFrame, by: str, n: int, largest: bool = True, keep: str = "first", tie: list[str] = ()) -> DataFrame:
    """The n largest (smallest) rows; keep="all" also keeps the rows level with the n-th.

    The n-th value comes from a distributed top-n, so no task sorts the table.
    """
    order = F.col(by).desc() if largest else F.col(by).asc()
    if keep == "first":
        return df.orderBy(order, *tie).limit(n)
    edge = df.select(by).orderBy(order).limit(n).agg((F.min(by) if largest else F.max(by)).alias("_edge")).scalar()
    return df.filter(F.col(by) >= edge if largest else F.col(by) <= edge)
