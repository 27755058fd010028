"""Streams give what the whole table gives, whatever the files."""

from pyspark.sql import functions as F

from pitloom.streaming import jobs


def _files(spark, df, folder, parts):
    """The parts of `df` one after the other, then a row far ahead that lets the watermark pass the rest."""
    for part in parts:
        df.filter(part).coalesce(1).write.mode("append").parquet(folder)
    end = df.limit(1).select(*(F.lit(-1).cast(f.dataType).alias(f.name) if f.name != "ts" else F.expr("timestamp'2100-01-01'").alias("ts") for f in df.schema))
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_in_any_file_order(spark, sf_dir, tmp_path):
    """Rows in order, rows in three shuffled files, and late ones all give the same; those behind the watermark are dropped."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.floor("value") % 20).alias("s")
    )
    orders = {"whole": [F.lit(True)], "mixed": [F.pmod(F.hash("event_id"), F.lit(3)) == k for k in range(3)], "back": [F.col("ts") >= "2024-01-15", F.col("ts") < "2024-01-15"]}

    def run(name, fn):
        out = {}
        for kind, parts in orders.items():
            s = _files(spark, e, str(tmp_path / f"{name}-{kind}"), parts)
            df = jobs.run_available(fn(s), str(tmp_path / f"{name}-{kind}-o"), str(tmp_path / f"{name}-{kind}-c"))
            out[kind] = sorted(tuple(r) for r in df.collect())
        return out

    got = run("session", lambda s: jobs.session_stream(s, "user_id", "ts", "event_id", "s", late="60 days"))
    assert len(got["whole"]) == e.count() and got["whole"] == got["mixed"] == got["back"]
    thirds = [F.col("ts") >= "2024-01-20", F.col("ts").between("2024-01-15", "2024-01-20"), F.col("ts") < "2024-01-15"]
    decay = jobs.entity_decay(_files(spark, e, str(tmp_path / "late"), thirds), "user_id", "ts", "event_id", "value", 30.0, late="1 day")
    kept = jobs.run_available(decay, str(tmp_path / "late-o"), str(tmp_path / "late-c"))
    assert kept.count() == e.filter("ts >= '2024-01-15'").count()  # the earlier half came when the watermark had long passed it


def test_entity_decay_of_one_instant(spark, tmp_path):
    rows = [(1, 7, 9, 1.0), (2, 7, 9, 3.0), (3, 7, 86409, 5.0), (4, 7, 86409, None), (5, 8, 9, None), (6, 8, 10, 2.0)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    s = _files(spark, e, str(tmp_path / "in"), [F.lit(True)])
    got = jobs.run_available(jobs.entity_decay(s, "user_id", "ts", "event_id", "value", 1.0), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, None, 0), (2, None, 0), (3, 2.0, 2), (4, 2.0, 2), (5, None, 0), (6, None, 0)]


def test_drift_against_versions(spark, tmp_path):
    base = [("2024-01-01", "a", [4.0, 4.0]), ("2024-01-10", "a", [1.0, 7.0]), ("2024-01-01", "b", [1.0, 1.0])]
    versions = spark.createDataFrame(base, "v string, feature string, counts array<double>").select(F.to_timestamp("v").alias("valid_from"), "feature", "counts")
    counts = spark.createDataFrame([("2023-12-25", "a", 0, 3), ("2024-01-08", "a", 0, 3), ("2024-01-15", "a", 0, 3), ("2024-01-15", "c", 0, 3)], "p string, feature string, bin long, c long")
    counts = counts.select(F.to_timestamp("p").alias("period"), "feature", "bin", "c")
    got = {str(r.period)[:10]: r.counts for r in jobs.valid_baseline(versions, counts).collect()}
    assert got == {"2023-12-25": [4.0, 4.0], "2024-01-08": [4.0, 4.0], "2024-01-15": [1.0, 7.0]}


def test_refresh_sees_only_new_files(spark, tmp_path):
    seen = []
    df = spark.range(5).select(F.col("id"))
    df.write.mode("append").parquet(str(tmp_path / "src"))

    def update(batch, _):
        seen.append(batch.count())

    for _ in range(2):
        jobs.refresh(spark, str(tmp_path / "src"), "id long", str(tmp_path / "c"), update)
    df.limit(2).write.mode("append").parquet(str(tmp_path / "src"))
    jobs.refresh(spark, str(tmp_path / "src"), "id long", str(tmp_path / "c"), update)
    assert sum(seen) == 7


def test_windowed_streams_and_log_sink(spark, sf_dir, tmp_path):
    from pitloom.operators import quality

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e = raw.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value"
    )

    q = jobs.log_sink(e, str(tmp_path / "log"), str(tmp_path / "log-c"), "m", rate=0.5, key=["event_id"]).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "log"))
    assert 0 < kept.count() < batch.count() and {"model", "dt"} <= set(kept.columns)

    flags = jobs.run_available(jobs.rate_flag(e, "event_type", "timestamp", 5, "1 hour", "30 minutes"), str(tmp_path / "r"), str(tmp_path / "r-c"))
    whole = jobs.rate_flag(batch, "event_type", "timestamp", 5, "1 hour", "30 minutes")
    # closed windows only: every emitted row is a row of the whole table
    assert flags.count() > 0 and flags.exceptAll(whole).count() == 0

    base = quality.psi_baseline(batch, ["value"])
    drift = jobs.drift_stream(e, base, ["value"], "timestamp", "7 days")
    counts = jobs.run_available(drift, str(tmp_path / "d"), str(tmp_path / "d-c"))
    assert counts.count() > 0 and counts.exceptAll(jobs.drift_stream(batch, base, ["value"], "timestamp", "7 days")).count() == 0
    assert all(r.psi >= 0 for r in jobs.drift_of(counts, base).collect())


def test_state_is_asked_by_bucket(spark, tmp_path):
    """Two thousand keys set no timer each; nulls, NaN and large ids come through."""
    e = spark.range(6000).select(
        (F.col("id") + (1 << 60) + 1).alias("event_id"), F.when(F.col("id") % 2000 != 7, F.col("id") % 2000).alias("user_id"), F.timestamp_seconds(F.floor(F.col("id") / 2000) + 9).alias("ts"),
        F.when(F.col("id") == 3, float("nan")).when(F.col("id") != 4, 2.0).alias("value"),
    )
    made = jobs.entity_decay(_files(spark, e, str(tmp_path / "in"), [F.lit(True)]), "user_id", "ts", "event_id", "value", 1.0)
    q = made.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    timers = [s.customMetrics.get("numRegisteredTimers", 0) for p in q.recentProgress for s in p.stateOperators]
    assert 0 < max(timers) <= 256
    got = {r.event_id - (1 << 60) - 1: (r.mean, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert len(got) == 6000 and got[7] == (None, 0) and got[2007] == (2.0, 1) and got[2004] == (None, 0) and got[4004] == (2.0, 1)
    assert got[2003][0] != got[2003][0] and got[2003][1] == 1
