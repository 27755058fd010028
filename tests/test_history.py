"""Windows against brute force, with hot keys, ties, gaps and empty histories."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitloom.operators import asof, entity, history, meta, stores
from pitloom.operators.history import Measure, trailing_sums

T0 = datetime(2024, 1, 1)


def rows_of(seed, n=160, keys=("hot", "b", "c"), hours=24 * 40):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(keys)
        # coarse steps give equal timestamps, exact window edges and bucket edges
        t = T0 + timedelta(hours=6 * rnd.randrange(hours // 6))
        out.append((i, key, t, rnd.choice([None, 1.0, 2.5, 7.0]), rnd.randrange(2)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, ts timestamp, x double, r int")


def brute(rows, window, half_life, seq=False):
    res = {}
    for i, k, t, _, _ in rows:
        s = w = 0.0
        n = 0
        for j, k2, t2, x, _ in rows:
            if k2 != k or x is None:
                continue
            if seq:
                age = (t.date() - t2.date()).days
                if (t2, j) >= (t, i) or (window is not None and age > window):
                    continue
            else:
                age = (t - t2).total_seconds() / 86400
                if age <= 0 or (window is not None and age > window):
                    continue
            f = 1.0 if half_life is None else 2 ** (-age / half_life)
            s, w, n = s + f * x, w + f, n + 1
        res[i] = (s, w, n)
    return res


@pytest.mark.parametrize("seq", [False, True])
@pytest.mark.parametrize("window,half_life", [(10, 7), (1, 45), (None, 180), (None, 2), (10, None)])
def test_trailing_sums_equals_brute_force(spark, seq, window, half_life):
    rows = rows_of(3)
    live = F.col("x").isNotNull()
    out = trailing_sums(
        frame(spark, rows),
        ["k"],
        "ts",
        {
            "s": Measure(F.col("x"), half_life, window),
            "w": Measure(F.when(live, 1.0), half_life, window),
            "n": Measure(F.when(live, 1), None, window),
        },
        isolation="sequence" if seq else "strict_time",
        seq=["ts", "id"],
    ).collect()
    want = brute(rows, window, half_life, seq)
    assert len(out) == len(rows)
    for row in out:
        s, w, n = want[row.id]
        assert (row.n or 0) == n
        if n:
            assert math.isclose(row.s, s, rel_tol=1e-9) and math.isclose(row.w, w, rel_tol=1e-9)
        else:
            assert row.s is None


def test_windows_of_different_length_share_a_pass(spark):
    rows = rows_of(5)
    m = {"a": Measure(F.col("x"), None, 1), "b": Measure(F.col("x"), None, 10), "c": Measure(F.col("x"), None, None)}
    got = {r.id: r for r in trailing_sums(frame(spark, rows), ["k"], "ts", m).collect()}
    for name, window in (("a", 1), ("b", 10), ("c", None)):
        for i, (s, _, n) in brute(rows, window, None).items():
            assert (got[i][name] or 0.0) == pytest.approx(s if n else 0.0)


def test_later_events_never_change_earlier_features(spark):
    rows = rows_of(7)
    cut = T0 + timedelta(days=20)
    early = [r for r in rows if r[2] <= cut]

    def run(rs):
        d = history.decayed_mean(frame(spark, rs), ["k"], "ts", "x", 7, 10)
        return {r.id: (r.mean, r.mean_n) for r in d.collect()}

    a, b = run(early), run(rows)
    for i in a:
        assert a[i][1] == b[i][1]
        assert (a[i][0] is None) == (b[i][0] is None)
        if a[i][0] is not None:
            assert a[i][0] == pytest.approx(b[i][0])


def test_order_of_input_does_not_matter(spark):
    rows = rows_of(9)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    run = lambda rs: sorted((r.id, r.streak) for r in history.streak(frame(spark, rs), ["k"], F.to_date("ts"), ["ts", "id"], "r").collect())
    assert run(rows) == run(shuffled)


def test_streak_and_last_n(spark):
    rows = rows_of(11)
    df = frame(spark, rows)
    got = {r.id: r.streak for r in history.streak(df, ["k"], F.to_date("ts"), ["ts", "id"], "r").collect()}
    last = {
        r.id: r.rate
        for r in history.last_n_rate(df.withColumn("us", F.unix_micros("ts")), ["k"], "ts", ["us", "id"], "r", 3, 10, out="rate").collect()
    }
    for i, k, t, _, _ in rows:
        prior = sorted((t2, j, r2) for j, k2, t2, _, r2 in rows if k2 == k and (t2, j) < (t, i))
        run = 0
        for _, _, r2 in reversed(prior):
            if run and (r2 == 1) != (run > 0):
                break
            run += 1 if r2 == 1 else -1
        assert got[i] == run
        strict = [r2 for t2, _, r2 in prior if t2 < t and t - t2 <= timedelta(days=10)][-3:]
        assert last[i] == (pytest.approx(sum(strict) / len(strict)) if strict else None)


def test_asof_edges_ages_and_reset(spark):
    left = spark.createDataFrame(
        [(1, "a", T0), (2, "a", T0 + timedelta(days=90)), (3, "a", T0 + timedelta(days=91)), (4, "z", T0), (5, "a", T0 - timedelta(days=1))],
        "id int, k string, t timestamp",
    )
    store = spark.createDataFrame([("a", T0, 1, 5.0, 1.0), ("a", T0, 2, 6.0, 2.0)], "k string, st timestamp, o int, v double, w double")
    out = {r.id: r for r in asof.asof_join(left, store, ["k"], "t", "st", ["v", "w"], 90, tie=["o"]).collect()}
    assert (out[1].v, out[2].v, out[3].v, out[4].v, out[5].v) == (6.0, 6.0, None, None, None)
    kept = {r.id: r for r in asof.asof_join(left, store, ["k"], "t", "st", ["v", "w"], 90, reset={"v": 0.5}, tie=["o"]).collect()}
    assert (kept[3].v, kept[3].w, kept[4].v) == (0.5, 2.0, None)
    strict = {r.id: r for r in asof.asof_join(left, store, ["k"], "t", "st", ["v"], 90, tie=["o"], strict=True).collect()}
    assert strict[1].v is None and strict[2].v == 6.0


def test_mastery_without_history_uses_the_prior(spark):
    df = spark.createDataFrame([("p", "c", T0, 1, 5, 0, 5, 10.0, 6.0)], "p string, c string, ts timestamp, result int, kills int, deaths int, assists int, g double, w double")
    got = entity.mastery(df, ["p", "c"], "ts", "g", "w").first().mastery_score
    assert got == pytest.approx(50 * 0.6 + 30 * math.log1p(10) / math.log1p(50) + 20 * 3 / 8)


def test_zero_deaths_give_the_numerator(spark):
    rows = [("p", T0, 1, 4, 0, 3), ("p", T0 + timedelta(days=1), 0, 1, 1, 1)]
    df = spark.createDataFrame(rows, "p string, ts timestamp, result int, kills int, deaths int, assists int")
    second = entity.entity_form(df, ["p"], "ts", 45).orderBy("ts").collect()[1]
    assert second.form_kda == pytest.approx(7 * 2 ** (-1 / 45)) and second.form_games == 1


def test_grudge_counts_only_earlier_games(spark):
    games = spark.createDataFrame([(1, 10, "A", "B"), (2, 11, "B", "A"), (3, 11, "A", "B")], "gameid long, day int, blue_team string, red_team string")
    bans = spark.createDataFrame([(1, "A", "B", 7), (2, "A", "B", 7), (2, "A", "B", 8)], "gameid long, team string, opponent string, champion_id long")
    per, newest = stores.grudge_store(games, bans)
    got = {(r.gameid, r.champion_id): r.rate for r in per.collect()}
    assert got == {(2, 7): 1.0, (3, 7): 1.0, (3, 8): 0.5}
    assert {r.champion_id: r.rate for r in newest.collect()} == {7: pytest.approx(2 / 3), 8: pytest.approx(1 / 3)}


def test_meta_drift_covers_every_date(spark):
    picks = spark.createDataFrame([(T0, "14.1", "X", 1), (T0 + timedelta(days=1), "14.1", "Y", 0)], "date timestamp, patch string, champion string, result int")
    games = spark.createDataFrame([(1, T0, "14.1"), (2, T0 + timedelta(days=1), "14.1")], "gameid long, date timestamp, patch string")
    got = {(r.champion, r.date): r.meta_win_rate_pit for r in meta.meta_drift(picks, games).collect()}
    assert len(got) == 4 and got[("X", T0)] == 0.5 and got[("X", T0 + timedelta(days=1))] == pytest.approx(2 / 3)


@pytest.mark.parametrize("window,half_life", [(None, 10.7), (90, 10.7), (None, 21), (365, 0.5), (40, 0.05)])
def test_decay_is_finite_for_any_date(spark, window, half_life):
    """Late, early and far-apart dates: finite, and equal to brute force while a weight is above exp(-600)."""
    starts = [datetime(1905, 3, 1), datetime(2030, 1, 1), datetime(2060, 5, 5), datetime(9990, 1, 1)]
    rows = [(10 * j + i, "k", t0 + timedelta(days=7 * i, hours=5 * i), float(i + 1), 0) for j, t0 in enumerate(starts) for i in range(8)]
    for seq in (False, True):
        out = trailing_sums(
            frame(spark, rows), ["k"], "ts", {"s": F.col("x")}, window_days=window, half_life=half_life, isolation="sequence" if seq else "strict_time", seq=["ts", "id"]
        )
        want = brute(rows, window, half_life, seq)
        for r in out.collect():
            s, _, n = want[r.id]
            assert r.s is None or math.isfinite(r.s)
            assert abs((r.s or 0.0) - s) <= 1e-9 * max(1.0, abs(s)), (r.id, r.s, s)


def test_a_busy_day_in_runs(spark):
    """A third of all rows on one day of one key, cut into runs, gives what one ordered day gives; times of day come before ids."""
    import random

    from pitloom.operators.history import decayed_mean

    r = random.Random(9)
    rows = [("a", "2024-01-05 %02d:00:00" % r.randrange(3), i, float(r.randrange(100))) for i in range(400)]
    rows += [(r.choice("abc"), "2024-01-%02d 00:00:00" % r.randrange(1, 20), 400 + i, float(r.randrange(100))) for i in range(800)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t string, id long, x double").withColumn("t", F.to_timestamp("t"))
    one = decayed_mean(df, ["k"], "t", "x", 5, 10, isolation="sequence", seq=["t", "id"])
    cut = decayed_mean(df, ["k"], "t", "x", 5, 10, isolation="sequence", seq=["t", "id"], run=16)
    want = {x.id: x for x in one.collect()}
    got = {x.id: x for x in cut.collect()}
    assert len(got) == len(rows) and max(df.filter("k = 'a' AND to_date(t) = '2024-01-05'").groupBy("t", F.floor(F.col("id") / 16)).count().select("count").collect())[0] <= 16
    assert all(got[i].mean_n == x.mean_n and (x.mean is None) == (got[i].mean is None) and abs((x.mean or 0) - (got[i].mean or 0)) < 1e-9 for i, x in want.items())
