"""Helpers shared by the corpus operators: text normal form, row keys, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}


def squeeze(text: Column) -> Column:
    """Every run of `[\\x20\\x09-\\x0D]` as one space; null is empty. A lone space is not touched, which saves a replacement a word."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by id and text (never null), so that rows that share an id but not a text are told apart."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only a purely local session gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="pitloom-")
    return _OWN_ROOT[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_rows(docs: DataFrame, keys: DataFrame, key: str = "row_key", once: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose row key stands in `keys[key]`, with the columns of `docs`; `once`: one of the rows that share a key."""
    own, other = fresh(docs, "row_key"), fresh(docs, "kept_row_key")
    found = docs.withColumn(own, row_key(F.col(doc_id), F.col(text))).join(
        keys.select(F.col(key).alias(other)), F.col(own) == F.col(other), "left_semi"
    )
    return (found.dropDuplicates([own]) if once else found).drop(own)
