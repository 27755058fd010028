"""Readers for match records and their side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitloom.functions.columns import parse_percent

CAREER_SCHEMA = "player_id STRING, champion STRING, games INT, win_rate DOUBLE, kda DOUBLE"


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet, CSV or JSON lines by suffix; CSV and JSON need an explicit schema."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix == "csv":
        return reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if suffix in ("json", "jsonl"):
        return reader.json(path)
    return reader.parquet(path)


def load_matches(spark, path, schema=None, date="date", fmt: str | None = None) -> DataFrame:
    """Match rows with a parsed date; text that is no date becomes null."""
    df = read_any(spark, path, schema)
    if isinstance(df.schema[date].dataType, T.StringType):
        parsed = F.try_to_timestamp(F.col(date), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(date))
        df = df.withColumn(date, parsed)
    return df


def dense_index(df: DataFrame, order: list[str], prefix: list[Column], name: str = "match_seq_idx") -> DataFrame:
    """0-based position in a total order, without sorting the table in one task.

    `prefix` are columns that grow with the order, coarse to fine. Rows are
    numbered inside a prefix cell; the cells get their offsets from counts.
    """
    names = [f"_p{i}" for i in range(len(prefix))]
    src = df.select("*", *[p.alias(n) for p, n in zip(prefix, names)])
    counts = src.groupBy(*names).agg(F.count("*").alias("_n"))
    # offsets level by level: inside the coarser cell, then between the coarse cells
    off = counts.withColumn("_off", F.lit(0).cast("long"))
    for level in range(len(names) - 1, -1, -1):
        keys = names[: level + 1]
        sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_m"))
        w = W.partitionBy(*(names[:level] or [F.lit(0)])).orderBy(names[level]).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.select(*keys, F.coalesce(F.sum("_m").over(w), F.lit(0)).alias("_o"))
        off = off.join(sizes, keys).withColumn("_off", F.col("_off") + F.col("_o")).drop("_o")
    local = src.withColumn("_r", F.row_number().over(W.partitionBy(*names).orderBy(*order)) - 1)
    return local.join(off.select(*names, "_off"), names).select(*df.columns, (F.col("_off") + F.col("_r")).alias(name))


def history_cut(df: DataFrame, months: int = 18, date: str = "date") -> DataFrame:
    """Rows of the last `months` calendar months before the newest date."""
    newest = df.agg(F.add_months(F.max(F.to_date(date)), -months).alias("c")).scalar()
    return df.filter(F.to_date(date) >= newest)


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("first"), F.max(date).alias("last"))


def _exists(spark: SparkSession, path: str) -> bool:
    hp = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hp.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hp)
    return found is not None and len(found) > 0


def load_career(spark, path: str) -> DataFrame:
    """Career rows, first row per (player, champion); a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CAREER_SCHEMA)
    return read_any(spark, path, CAREER_SCHEMA)


# Names that sources use for the same column.
PAIR_ALIASES = {
    "opponent_name": ("opponent_name", "opponent", "champion2", "partner"),
    "champion": ("champion", "champion1", "champion_name"),
    "games": ("games", "matches", "total_games"),
    "win_rate": ("win_rate", "winrate", "wr"),
}


def normalise_pairs(df: DataFrame) -> DataFrame:
    """Rename known spellings and read percent text."""
    have = {c.lower().strip(): c for c in df.columns}
    ren = {}
    for want, names in PAIR_ALIASES.items():
        found = next((have[n] for n in names if n in have), None)
        if found is not None and want not in df.columns:
            ren[found] = want
    out = df.withColumnsRenamed(ren)
    for want in PAIR_ALIASES:
        if want not in out.columns:
            out = out.withColumn(want, F.lit(None).cast("string"))
    return out.withColumns({"win_rate": parse_percent("win_rate"), "games": F.col("games").cast("string").try_cast("int")})


def load_pairs(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary source, or the secondary one when the primary has no readable win rate at all.

    The choice is one scalar inside the plan; no row comes to the driver.
    """
    a, b = normalise_pairs(primary), normalise_pairs(secondary)
    usable = a.agg(F.count_if(F.col("win_rate").isNotNull()).alias("n")).scalar()
    cols = [c for c in a.columns if c in b.columns]
    return a.select(cols).filter(usable > 0).unionByName(b.select(cols).filter(usable == 0))


def load_vocab(spark, path: str) -> DataFrame:
    """Vocabulary JSON {"name_to_idx": {name: id}} as rows (champion, idx)."""
    raw = spark.read.schema("name_to_idx MAP<STRING, BIGINT>").option("multiLine", True).json(path)
    return raw.select(F.explode("name_to_idx").alias("champion", "idx"))


def load_position_prior(spark, path: str) -> DataFrame:
    """Prior JSON {champion: {position: probability}} as rows (champion, position, probability)."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
    return text.select(F.explode(m).alias("champion", "_p")).select("champion", F.explode("_p").alias("position", "probability"))


def league_teams(rosters: DataFrame) -> DataFrame:
    return rosters.groupBy("league").agg(F.sort_array(F.collect_set("team")).alias("teams"))


def team_players(rosters: DataFrame) -> DataFrame:
    """Per team the players in role order."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("top", "jng", "mid", "bot", "sup")]), F.col("role"))
    entry = F.struct(F.when(rank > 0, rank).otherwise(9).alias("o"), "player_id", "role")
    return rosters.groupBy("league", "team").agg(
        F.transform(F.array_sort(F.collect_set(entry)), lambda e: e["player_id"]).alias("players")
    )


def discover(spark, pattern: str, year_regex: str = r"(\d{4})") -> DataFrame:
    """Files that match a glob with the year in their name (metadata only, newest first)."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("year", F.regexp_extract(name, year_regex, 1).try_cast("int")).orderBy(
        F.col("year").desc_nulls_last(), F.col("path").desc()
    )
