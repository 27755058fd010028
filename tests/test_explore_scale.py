"""What a plan works out per row of its input."""

from pyspark.sql import functions as F

from pitloom.operators import explore


def test_template_fill_does_not_unfold_the_champions_for_each_game(spark):
    games = spark.range(40).select(*[F.concat(F.lit("C"), ((F.col("id") + i) % 4).cast("string")).alias(f"p{i}") for i in range(3)], F.lit(1).alias("won"))
    cores = explore.core3(games, ["p0", "p1", "p2"], "won").select(F.split("core", r"\+").alias("core"))
    stats = spark.createDataFrame(
        [(f"C{i}", p, 10 * i + j, 0.1, 0.5, 0.1, 3.0, 100.0, 100.0) for i in range(6) for j, p in enumerate(("top", "mid", "sup"))],
        "champion string, position string, picks int, pick_rate double, win_rate double, ban_rate double, kda double, dpm double, gpm double",
    )
    pairs = spark.createDataFrame([("C4", "C1", 0.6, 60.0)], "a string, b string, win_rate double, score double")
    counters = spark.createDataFrame([("C5", "C2", 0.6, "easy")], "champion string, opponent_name string, opponent_win_rate double, matchup_type string")
    out = explore.template_fill(cores, stats, pairs, counters, n=50)
    # the home of every champion is sup, so other champions are left at top and mid only
    got = {(r.core, r.champion, r.position) for r in out.collect()}
    known = {"+".join(sorted(f"C{(g + i) % 4}" for i in range(3))) for g in range(4)}
    assert got == {(c, f"C{i}", p) for c in known for i in range(6) if f"C{i}" not in c.split("+") for p in ("top", "mid")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(filter(" not in plan
