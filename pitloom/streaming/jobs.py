"""Streaming forms. The windowed functions take batch or streaming DataFrames, the stateful
ones streaming DataFrames; all return DataFrames.

Watermarks and late-data handling are additions of ours. Stateful operators
fold a key's rows in the order of event time (`ordered`) and keep a small state
per key (sums, the last n values, a counter) besides the rows that the watermark
has not passed; the windowed decays of the batch side stay in batch, because
they would have to keep every event of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.operators.quality import _bin, psi_value, unfold
from pitloom.sources.stores_io import append_log
from pitloom.streaming.ordered import fold_in_order


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables: the shared one that spark.checkpoint.dir names; a purely local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="pitloom-")
    return root


def log_sink(df: DataFrame, path: str, checkpoint: str, model: str, ts: str = "timestamp", rate: float = 1.0, key: list[str] = ("request_id",), **kw):
    """Writes a feature stream to daily partitions, sampled by a hash of `key`. A micro-batch has folders of its own, so one that is repeated replaces itself."""

    def update(batch: DataFrame, number: int) -> None:
        append_log(batch, path, model, number, ts, rate, list(key), **kw)

    return df.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).outputMode("append")


def rate_flag(df: DataFrame, key: str, ts: str = "ts", limit: int = 120, window: str = "60 seconds", slide: str = "1 second", late: str = "5 minutes") -> DataFrame:
    """Requests per key and sliding window with a flag above the limit.

    Rows are counted once, in panes of one slide; only panes are copied into the windows that hold them. On a stream
    these are two aggregations in a row, and the state has a row per pane and per open window.
    """
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    panes = rows.groupBy(F.window(ts, slide).alias("pane"), key).agg(F.count("*").alias("n"))
    n = panes.groupBy(F.window(F.window_time("pane") if df.isStreaming else F.col("pane.start"), window, slide).alias("window"), key).agg(F.sum("n").alias("n"))
    return n.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("n") > limit).alias("limited"))


def drift_stream(df: DataFrame, baseline: DataFrame, cols: list[str], ts: str = "ts", period: str = "7 days", start: str | None = None, late: str = "1 day", bins: int = 10) -> DataFrame:
    """Bin counts per feature and tumbling period against a static baseline.

    baseline: feature, counts, bin_edges (a row per feature). The result holds
    one row per (period, feature, bin); `drift_of` turns it into the index.
    """
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    edges = baseline.select("feature", F.element_at("bin_edges", 1).alias("lo"), F.element_at("bin_edges", -1).alias("hi"))
    long = unfold(rows, cols, [ts]).join(F.broadcast(edges), "feature")
    b = long.withColumn("_bin", _bin(F.col("value"), F.col("lo"), F.col("hi"), bins)).filter(F.col("_bin").isNotNull())
    w = F.window(ts, period, period, start) if start else F.window(ts, period)
    return b.groupBy(w, "feature", "_bin").agg(F.count("*").alias("c")).select(
        F.col("window.start").alias("period"), "feature", F.col("_bin").alias("bin"), "c"
    )


def drift_of(counts: DataFrame, baseline: DataFrame, bins: int = 10, by: list[str] = ("feature",)) -> DataFrame:
    """Index per (period, feature) from the closed periods of `drift_stream`. `baseline` has counts for each `by`."""
    m = counts.groupBy("period", "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_m"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
    cur = m.withColumn("_cur", F.transform(slots, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double")))
    return cur.join(baseline.select(*by, "counts"), list(by)).select("period", "feature", psi_value(F.col("counts"), F.col("_cur")).alias("psi"))


def valid_baseline(baselines: DataFrame, counts: DataFrame) -> DataFrame:
    """period, feature, counts: of the versions of a baseline (valid_from, feature, counts) the newest that was valid when a period of `counts` began, or the first."""
    met = counts.select("period", "feature").distinct().join(baselines.select("valid_from", "feature", "counts"), "feature")
    at, in_time = F.unix_micros("valid_from"), F.col("valid_from") <= F.col("period")
    return met.groupBy("period", "feature").agg(F.max_by("counts", F.struct(in_time.alias("in_time"), F.when(in_time, at).otherwise(-at))).alias("counts"))


def drift_monitor(counts: DataFrame, baselines: str, path: str, checkpoint: str):
    """Writes the index of each period that the watermark has closed: a stream of `drift_stream` against versions of a baseline.

    The folder `baselines` (valid_from, feature, counts, bin_edges) is read anew in every micro-batch, so a version that is added later
    counts from then on; all versions are counted over the same edges. A batch writes its own partition, so one that is repeated after a loss replaces itself.
    """

    def update(batch: DataFrame, number: int) -> None:
        base = valid_baseline(batch.sparkSession.read.parquet(baselines), batch)
        drift_of(batch, base, by=["period", "feature"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).outputMode("append")


def rolling_monitor(
    df: DataFrame, limits: dict, key: str = "metric", ts: str = "ts", seq: str = "seq", value: str = "value", reset: str | None = None, size: int = 30, late: str = "1 day"
) -> DataFrame:
    """Degrade, recover and reset events of the mean over the last `size` values of each metric: metric, at (the row's `seq`), event, mean.

    A row whose `reset` is true empties the window and ends a degraded state (as after a full retraining); its value is not read.
    The state of a metric is its last values.
    """
    need = max(5, size // 2)
    floor = {k: float(v) for k, v in limits.items()}

    def fold(k, state, rows):
        values, bad = (list(state[0]), state[1]) if state else ([], False)
        out = []
        for _, at, x, again in rows:
            if again:
                values, bad = [], False
                out.append((k, at, "reset", None))
                continue
            values = [*values, x][-size:]
            mean = sum(values) / len(values)
            now = len(values) >= need and mean < floor.get(k, float("-inf"))
            if now != bad:
                out.append((k, at, "degraded" if now else "recovered", mean))
            bad = now
        return (values, bad), out

    columns = {"at": F.col(seq).cast("long"), "x": F.col(value).cast("double"), "again": F.col(reset) if reset else F.lit(False)}
    return fold_in_order(
        df, F.col(key), ts, columns, fold, "metric string, at long, event string, mean double", late
    )


def entity_decay(df: DataFrame, key: str, ts: str, event: str, value: str, half_life: float, late: str = "1 day") -> DataFrame:
    """Decayed mean and count of a key's earlier events, kept as (sum, weight, n, time).

    The state moves forward by 2^(-dt / half_life) from one instant to the next; features are emitted before an
    instant's events are added, so these do not see each other.
    """
    lam_us = 0.6931471805599453 / (half_life * 86_400_000_000.0)

    def fold(k, state, rows):
        import math
        from itertools import groupby

        s, w, n, last = state or (0.0, 0.0, 0, 0)
        out = []
        for t, same in groupby(rows, key=lambda r: r[0]):
            if n:
                f = math.exp(-lam_us * (t - last))
                s, w = s * f, w * f
            same = list(same)
            out += [(i, s / w if w > 0 else None, n) for _, i, _ in same]
            for _, _, x in same:
                if x is not None:
                    s, w, n = s + x, w + 1.0, n + 1
            last = t
        return (s, w, n, last), out

    columns = {"event": F.col(event).cast("long"), "x": F.col(value).cast("double")}
    return fold_in_order(df, F.col(key), ts, columns, fold, "event_id long, mean double, n long", late)


def draft_stream(df: DataFrame, game: str = "gameid", ts: str = "ts", first_id: int = 7, last_step: int = 19, late: str = "1 day") -> DataFrame:
    """What a draft looks like before each step: gameid, step, ally, enemy (picks of the acting and of the other side, in order), unavailable (all champions picked or banned, in order).

    df: gameid, ts, step, action, side, champion_id. Ids below `first_id` are no champions. A game is forgotten after its last step.
    """

    def fold(k, state, rows):
        sides = {"blue": list(state[0]), "red": list(state[1])} if state else {"blue": [], "red": []}
        used, out, step = list(state[2]) if state else [], [], 0
        for _, step, action, side, cid in rows:
            out.append((k, step, list(sides[side]), list(sides["red" if side == "blue" else "blue"]), list(used)))
            if cid is not None and cid >= first_id:
                used.append(cid)
                if action == "pick":
                    sides[side].append(cid)
        return (None if step >= last_step else (sides["blue"], sides["red"], used)), out

    columns = {"step": F.col("step").cast("long"), "action": F.col("action"), "side": F.col("side"), "cid": F.col("champion_id").cast("long")}
    return fold_in_order(
        df,
        F.col(game).cast("long"),
        ts,
        columns,
        fold,
        "gameid long, step long, ally array<long>, enemy array<long>, unavailable array<long>",
        late,
    )


def session_stream(df: DataFrame, key: str, ts: str, event: str, step: str, late: str = "1 day") -> DataFrame:
    """Match number per event: one more whenever the step does not grow."""

    def fold(k, state, rows):
        no, prev = state or (0, None)
        out = []
        for _, i, s in rows:
            no += 1 if prev is not None and s <= prev else 0
            prev = s
            out.append((i, k, no))
        return (no, prev), out

    columns = {"event": F.col(event).cast("long"), "step": F.col(step).cast("long")}
    return fold_in_order(df, F.col(key).cast("long"), ts, columns, fold, "event_id long, key long, match_no long", late)


def refresh(spark: SparkSession, source: str, schema: str, checkpoint: str, update) -> None:
    """One incremental run: new files since the last run go through `update(batch, id)`, then it stops.

    `update` should write idempotently per batch id (for instance overwrite the
    touched partitions), so a repeated batch after a lost executor is harmless.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over everything that is there, into a parquet folder, and read it back."""
    q = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
