"""Steps that must not grow faster than their input, on rows of their own."""

import random

import pytest
from pyspark.sql import functions as F

from pitloom.operators import candidates, derive, entity, history, lookups, ranking, stores
from pitloom.plans import pipelines
from pitloom.operators.reshape import ROLES, SIDES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def slots_game(spark, ids):
    names = [f"{s}_{p}" for s in SIDES for p in ROLES]
    cols = [F.concat(F.lit(f"{n}_"), F.col("gameid") % 3).alias(f"{n}_{k}") for n in names for k in ("player_id", "champion")]
    return spark.createDataFrame([(i,) for i in ids], "gameid long").select("gameid", *cols)


def test_slots_are_merged_and_folded_in_one_go(spark):
    games = slots_game(spark, [1, 2, 2, None])
    store = spark.createDataFrame(
        [(1, "blue_top_1", "blue_top_1", 0.5, 3), (1, "blue_top_1", "blue_top_1", 0.75, None), (2, "red_sup_2", "red_sup_2", None, 7), (None, "blue_top_1", "blue_top_1", 0.1, 1)],
        "gameid long, player_id string, champion string, a double, b int",
    )
    out = lookups.attach_slots(games, store, ["gameid", "player_id", "champion"], {"a": 0.25, "b": 0})
    got = {r.gameid: r for r in out.collect()}
    assert sorted(got, key=str) == [1, 2, None]
    assert (got[1].blue_top_a, got[1].blue_top_b, got[1].red_sup_a) == (0.75, 3, 0.25)
    assert (got[2].red_sup_a, got[2].red_sup_b) == (0.25, 7)
    assert got[None].blue_top_a == 0.25 and got[None].red_sup_b == 0
    text = plan(out)
    assert "SortMergeJoin" in text and "Broadcast" not in text  # the unfolded store is no broadcast
    assert text.count("max(") < 20  # not a buffer for each slot and column


def test_sequence_decay_of_a_long_silent_key(spark):
    rows = [(1, 0, 2.0), (1, 500, 8.0), (2, 10_000_000, 5.0), (2, 9_000_000, 1.0), (3, None, 4.0)]
    got = {r.k: (r.value, r.n) for r in history.sequence_decay(spark.createDataFrame(rows, "k int, s long, x double"), ["k"], "s", "x").collect()}
    assert got[1] == (pytest.approx((2.0 * 0.5 + 8.0) / 1.5), 2)
    assert got[2] == (pytest.approx(5.0), 2)
    assert got[3] == (None, 1)


def test_grudges_are_listed_from_blocks_of_meetings(spark):
    n = 150  # more meetings than a block holds
    games = spark.createDataFrame([(i, i // 4, "a", "b") for i in range(n)], "gameid long, day long, blue_team string, red_team string")
    banned = {i: 7 + i % 3 for i in range(0, n, 7)}
    bans = spark.createDataFrame([(i, "a", "b", c) for i, c in banned.items()], "gameid long, team string, opponent string, champion_id long")
    out = stores.grudge_store(games, bans)[0]
    want = {(i, c): round(min(sum(x == c for j, x in banned.items() if j < i) / i, 1.0), 6) for i in range(1, n) for c in (7, 8, 9) if any(x == c for j, x in banned.items() if j < i)}
    assert {(r.gameid, r.champion_id): r.rate for r in out.collect()} == want
    text = plan(out)
    assert text.index("filter(_met") < text.index("Join")  # what is listed goes into no join


def test_rows_of_grudge_scans_are_sent_once(spark):
    games = spark.createDataFrame([(1, 1, "a", "b"), (2, 2, "a", "b"), (3, 3, None, "b"), (4, 4, "b", "a")], "gameid long, day long, blue_team string, red_team string")
    bans = spark.createDataFrame([(1, "a", "b", None), (1, "b", "a", 7), (2, "a", "b", 7), (3, None, "b", 7)], "gameid long, team string, opponent string, champion_id long")
    out = stores.grudge_store(games, bans)[0]
    got = {(r.gameid, r.team, r.champion_id): r.rate for r in out.collect()}
    assert got == {(2, "a", None): 1.0, (4, "a", None): 0.5, (4, "a", 7): 0.5, (2, "b", 7): 1.0, (4, "b", 7): 0.5}
    assert "<=>" not in plan(out) and "isnull(champion_id" not in plan(out)  # no join of a scan that tells nulls apart, for which its rows are sent again


def test_filters_take_queries_with_their_candidates(spark):
    rnd = random.Random(5)
    pos = lambda: rnd.choice([[0.9, 0.1, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 0.0]]) if rnd.random() < 0.4 else [rnd.random() for _ in range(5)]
    pri = spark.createDataFrame([(i, rnd.sample(p := pos(), len(p))) for i in range(7, 27)], "candidate_id long, pos array<double>")
    lists = [(i, [rnd.randrange(7, 29) for _ in range(rnd.randrange(0, 6))]) for i in range(60)]
    q = spark.createDataFrame(lists, "q int, ally array<long>").withColumn("enemy", F.reverse("ally"))
    ids = spark.range(7, 29).withColumnRenamed("id", "candidate_id")
    rows = q.crossJoin(ids)
    facts = {"meta_wr": F.lit(0.5), "meta_presence": F.lit(0.1), "meta_ban": F.lit(0.3)}
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(ranking.filter_ban_conflicts(q, pri, candidates=ids)) == key(ranking.filter_ban_conflicts(rows, pri))
    assert key(ranking.enrich(q, pri, candidates=ids, facts=facts)) == key(ranking.enrich(rows.withColumns(facts), pri))
    kept = ranking.filter_pick_conflicts(q, pri, candidates=ids)
    assert key(kept) == key(ranking.filter_pick_conflicts(rows, pri))
    fits = {r.candidate_id: [i for i in range(5) if r.pos[i] >= 0.15] or list(range(5)) for r in pri.collect()}

    def assignable(team, taken=()):
        return not team or any(assignable(team[1:], (*taken, i)) for i in fits.get(team[0], range(5)) if i not in taken)

    got = {(r.q, r.candidate_id) for r in kept.collect()}
    assert got and all(assignable([*dict(lists)[i], c]) for i, c in got if dict(lists)[i])


def _sorts_and_joins(spark, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(" Sort [" in x or x.startswith("Sort [") for x in plan.splitlines()), [x for x in plan.splitlines() if "Join" in x]


def test_rankings_are_sorted_once_a_score(spark):
    from pitloom.operators.quality import align_rankings

    rows = [(1, i, [0.5, 0.5, None, 0.1, 0.9][i % 5], float(i // 3), int(i == 4)) for i in range(12)]
    df = spark.createDataFrame(rows, "q long, cand long, a double, b double, label int")
    out = align_rankings(df, "q", "a", "b", "cand", 3, "label")
    assert _sorts_and_joins(spark, out)[0] <= 3
    got = out.first()
    ra, rb = ([sorted(r[i] if r[i] is not None else -1.0 for r in rows) for i in (2, 3)])
    import numpy as np

    mean = lambda xs, v: np.mean([i for i, x in enumerate(xs) if x == v])
    spearman = np.corrcoef([mean(ra, -1.0 if r[2] is None else r[2]) for r in rows], [mean(rb, r[3]) for r in rows])[0, 1]
    assert abs(got.spearman - spearman) < 1e-9 and got.label_rank_a == 1 and got.depth == 3


def test_items_of_games_meet_earlier_days_and_slots_before_they_are_unfolded(spark):
    """The rows of every game and item join the sums of the runs only."""
    from pitloom.operators.meta import meta_patch_weighted

    games = spark.createDataFrame([(1, 10, "1.1"), (2, 10, "1.1"), (3, 11, "1.2"), (4, None, "1.1")], "gameid long, day int, patch string")
    picks = games.crossJoin(spark.createDataFrame([("a", 1), ("b", 0), (None, 1)], "champion string, result int"))
    bans = games.crossJoin(spark.createDataFrame([("c",)], "champion string"))
    out = meta_patch_weighted(picks, bans, games)
    assert not [x for x in _sorts_and_joins(spark, out)[1] if "coalesce(champion" in x]
    got = {(r.gameid, r.champion): (r.meta_pick_rate_pit, r.meta_win_rate_pit) for r in out.collect()}
    assert set(got) == {(g, c) for g in (2, 3) for c in "abc"}
    assert got[2, "a"] == (1.0, 2 / 3) and got[2, "c"] == (0.0, 0.5)
    assert abs(got[3, "b"][0] - 1.0) < 1e-9


def test_pick_shares_of_players_with_games_of_no_day(spark):
    from pitloom.operators.entity import pick_distribution

    rows = [("p", 1, 5, "a"), ("p", 2, 5, "b"), ("p", 3, 6, "a"), ("p", 4, 99, "b"), ("p", 5, None, "a"), ("p", 6, None, "a"), ("p", 7, 100, None), ("p", 8, 101, "c")]
    h = spark.createDataFrame(rows, "player_id string, gameid long, day int, champion string")
    got = {}
    for r in pick_distribution(h, 90, 2).orderBy("gameid", "rank").collect():
        got.setdefault(r.gameid, []).append((r.pick_dist_champion, r.pick_dist_pct))
    assert got == {2: [("a", 1.0)], 3: [("a", 0.5), ("b", 0.5)], 7: [("b", 1.0)], 8: [("b", 0.5), (None, 0.5)]}


def test_hot_streak_when_the_best_falls(spark):
    from pitloom.operators.stores import hot_streak_store

    rows = [("p", i, i, c, w, 3, 1, 2) for i, (c, w) in enumerate([("a", 1), ("a", 1), ("b", 1), ("b", 0), ("a", 0), ("a", 0), ("a", 0), ("b", 1), ("b", 1)])]
    h = spark.createDataFrame(rows, "player_id string, gameid long, day int, champion string, result int, kills int, deaths int, assists int")
    v = spark.createDataFrame([("a", 7), ("b", 8)], "champion string, idx long")
    got = {r.gameid: (r.hot_champion_id, round(r.hot_win_rate, 4)) for r in hot_streak_store(h, v)[0].collect()}
    assert got == {2: (7, 1.0), 3: (7, 1.0), 4: (7, 1.0), 5: (7, 0.6667), 6: (7, 0.5), 7: (8, 0.5), 8: (8, 0.6667)}


def test_limited_windows_are_no_sliding_frames(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(60), float(rng.randrange(9))) for k in (1, 2, None) for _ in range(80)] + [(1, None, 2.0)]
    df = spark.createDataFrame(rows, "k int, d int, x double").select("*", F.timestamp_seconds(F.col("d").cast("long") * 86_400).alias("ts"))
    out = history.trailing_sums(df, ["k"], "ts", {"s": history.Measure(F.col("x"), None, 7), "w": history.Measure(F.col("x"), 3.0, 7), "l": history.Measure(F.col("x"), 3.0, 20)})
    for r in out.filter("k = 1 and d is not null").collect():
        def want(life, span):
            v = [x * (2 ** (-(r.d - d) / life) if life else 1) for k, d, x in rows if k == 1 and d is not None and r.d - span <= d < r.d]
            return pytest.approx(sum(v)) if v else None

        assert (r.s, r.w, r.l) == (want(None, 7), want(3.0, 7), want(3.0, 20))
    text = plan(out)
    assert "specifiedwindowframe(RangeFrame, -6" not in text and "specifiedwindowframe(RangeFrame, -19" not in text


def test_a_pool_is_unfolded_by_all_tasks(spark):
    df = spark.createDataFrame([("p", day, None) for day in range(64)], "player_id string, date int, champion string")
    pool = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "a"), ("q", "c")], "player_id string, champion string")
    out = entity.dense_rows(df, "player_id", "champion", pool, 4)
    assert out.count() == 128
    assert len({r.t for r in out.select(F.spark_partition_id().alias("t")).collect()}) == 4


def test_composition_is_joined_before_the_differences(spark):
    n = [f"{s}_{p}" for s in SIDES for p in ROLES]
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "gameid long")
    df = df.select("gameid", *[F.lit(f"C{i}").alias(f"{x}_champion") for i, x in enumerate(n)], *[F.lit(i * 1.5).alias(f"{x}_mastery_score") for i, x in enumerate(n)])
    tags = spark.createDataFrame([("C0", 3, None), ("C5", 2, 4)], "champion string, engage int, poke int")
    tags = tags.select("*", *[F.lit(1).alias(t) for t in derive.TAGS if t not in ("engage", "poke")])
    out = derive.derive_features(df, tags)
    rows = out.collect()
    assert sorted(r.gameid for r in rows) == [1, 2, 2]
    one = next(r for r in rows if r.gameid == 1)
    assert (one.blue_comp_engage_sum, one.red_comp_poke_sum, one.diff_top_mastery_score) == (7.0, 8.0, -7.5)
    names = out.columns
    assert names.index("diff_team_wr_balance") < names.index("blue_comp_engage_sum") < names.index("blue_bloodiness_x_aggression")
    under = plan(out).split("SortMergeJoin")[-1]
    assert "diff_top_mastery_score" not in under  # what needs no join is not shuffled


def test_stores_may_rest_on_written_ones(spark, tmp_path):
    frames = {"a": spark.range(3), "b": lambda written: written["a"].filter("id > 0")}
    out = pipelines.write_stores(frames, str(tmp_path))
    assert out["b"].count() == 2 and "a" in frames["b"](out).inputFiles()[0].split("/")


def test_candidates_are_made_from_one_row_per_lineup(spark):
    rnd = random.Random(11)
    ids = list(range(5, 15))  # 5 and 6 are no champions
    pos = {i: rnd.choice([[0.9, 0.1, 0.0, 0.0, 0.0], [0.2, 0.2, 0.3, 0.2, 0.1], [0.0, 0.0, 0.0, 0.1, 0.9]]) for i in ids}
    syn = {i: {j: round(rnd.random(), 3) for j in ids if rnd.random() < 0.5} for i in ids}
    ctr = {i: {j: rnd.choice([0.4, 0.7, None]) for j in [*ids, 99] if rnd.random() < 0.5} for i in ids}
    dim = spark.createDataFrame([(i, pos[i], syn[i] or None, ctr[i]) for i in ids], "candidate_id long, pos array<double>, syn map<long,double>, ctr map<long,double>")
    vocab = spark.createDataFrame([(f"C{i}", i) for i in ids], "champion string, idx long")
    a, b = [f"a{i}" for i in range(5)], ["b0", "b1", None, "b3", "b4"]
    teams = [(1, "x", "y", a, b, "C7| C8|?"), (1, "y", "x", b, a, "C7| C8|?"), (2, "x", "y", a, b, None), (None, "x", "y", a, b, "C9")]
    q = []
    for g, team, opp, ally, enemy, prev in teams:
        for step in range(4):
            drawn = rnd.sample([*ids[2:], 99], 4)
            used = None if step == 3 else [*drawn, None] if step == 2 else drawn
            q.append((len(q), g, team, opp, drawn[:step], drawn[step:], used, step % 2, step, 1, ally, enemy, prev, rnd.choice(ids)))
    names = "query_id gameid team opponent ally enemy unavailable is_pick ban_step is_red_side ally_pids enemy_pids prev_game_champs label".split()
    kinds = "long long string string array<long> array<long> array<long> int int int array<string> array<string> string long".split()
    queries = spark.createDataFrame(q, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    num = lambda: rnd.choice([None, round(rnd.uniform(0, 9), 2)])
    meta = [(g, c, *[num() for _ in range(4)]) for g in (1, 2, None) for c in ids[::2]]
    play = [(g, p, c, *[num() for _ in range(7)]) for g in (1, 2) for p in (*a[:3], "b0", "b4", None) for c in rnd.sample(ids, 4)]
    grudge = [(1, "x", "y", 8, 0.25), (1, "y", "x", 9, None), (2, "x", "y", 8, 0.5), (2, None, "y", 9, 0.5)]
    resp, hot = [(1, "b0", 8, 0.5), (1, "b4", 8, 0.75), (1, None, 9, 0.9), (1, "a1", 10, None)], [(1, "a0", 11, 0.5), (2, "b1", None, 0.5)]
    frame = lambda rows, head, cols: spark.createDataFrame(rows, head + ", " + ", ".join(f"{c} double" for c in cols))
    threat = lambda rows: spark.createDataFrame(rows, "gameid long, player_id string, champion_id long, value double")
    tables = (
        frame(meta, "gameid long, champion_id long", candidates.META),
        frame(play, "gameid long, player_id string, champion_id long", candidates.PLAYER),
        frame(grudge, "gameid long, team string, opponent string, champion_id long", ["rate"]),
    )
    metas, plays = {x[:2]: x[2:] for x in meta}, {x[:3]: x[3:] for x in play if x[1]}  # no name, no row
    for mode in ("train", "serve"):
        out = candidates.candidate_features(queries, dim, *tables, threat(resp), threat(hot), vocab, mode)
        text = plan(out)
        assert "Generate" not in text and "Broadcast" not in text  # the product is neither unfolded from nor joined to a row per query
        got = {(r.query_id, r.candidate_id): r for r in out.collect()}
        assert len(got) == len(ids) * sum(x[1] is not None for x in q)
        occ = lambda team, i: sum(pos[c][i] for c in team if c in pos)
        clip = lambda x: min(max(x, 0.0), 1.0)
        val = lambda x, d: d if x is None else x
        for n, g, team, opp, ally, enemy, used, pick, ban, red, mine, their, prev, label in q:
            if g is None:
                continue
            banned = [int(x.strip()[1:]) for x in (prev or "").split("|") if x.strip()[1:].isdigit()]
            am = [clip((1.2 if mode == "serve" else 1.0) - occ(ally, i)) for i in range(5)]
            em = [clip(1.0 - occ(enemy, i)) for i in range(5)]
            pairs = lambda m, side, c, f=lambda x: x: max((f(val(m[c].get(x), 0.5)) for x in side), default=0.0)
            stat = lambda p, c, k: val(plays.get((g, p, c), [None] * 7)[k], candidates.PLAYER_DEFAULT[k])
            for c in ids:
                r = got[n, c]
                want = dict(zip(candidates.META, (val(x, d) for x, d in zip(metas.get((g, c), [None] * 4), candidates.META_DEFAULT))))
                want |= {name: max(stat(p, c, k) * m for p, m in zip(mine, am)) for k, name in enumerate(candidates.PLAYER)}
                them = [stat(p, c, 0) * m for p, m in zip(their, em)]
                flip = lambda x: 1 - x
                want |= {"ally_synergy": pairs(syn, ally, c), "enemy_synergy": pairs(syn, enemy, c), "enemy_counter": pairs(ctr, enemy, c, flip), "ally_counter": pairs(ctr, ally, c, flip)}
                want |= {"enemy_mastery_max": max(them), "enemy_mastery_mean": sum(them) / 5, "n_ally_picked": len(ally), "is_pick": pick, "ban_step": ban, "is_red_side": red}
                want |= {"last_ally_synergy": val(syn[c].get(ally[-1]), 0.5) if ally else 0.5, "is_fearless_banned": float(c in banned)}
                want["grudge"] = val({x[:4]: x[4] for x in grudge}.get((g, team, opp, c)), 0.0)
                for name, rows in (("respect", resp), ("hot_streak", hot)):
                    want[name] = max((v for i, p, x, v in rows if i == g and x == c and v is not None and p in their and p is not None), default=0.0)
                if mode == "train":
                    want |= {"ally_role_fit": sum(p * m for p, m in zip(pos[c], am)), "enemy_role_fit": sum(p * m for p, m in zip(pos[c], em))}
                else:
                    best = max(pos[c])
                    at, hard = pos[c].index(best), best >= candidates.HARD
                    fit = lambda o: 0.0 if hard and o >= candidates.HARD else max(0.0, (1.0 if hard else 1.2) - o)
                    want |= {"ally_role_fit": fit(occ(ally, at)), "enemy_role_fit": fit(occ(enemy, at))}
                want |= {f"pos_{p}": x for p, x in zip(ROLES, pos[c])}
                assert {k: getattr(r, k) for k in candidates.CANDIDATE_COLUMNS} == pytest.approx(want), (mode, n, c)
                free = None if c >= 7 and c not in banned and (used is None or (None in used and c not in used)) else int(c >= 7 and c not in banned and c not in used)
                assert r.mask == (1 if mode == "train" and c == label else free), (mode, n, c)
                assert r.gameid == g and r.label == label


@pytest.mark.parametrize("half_life", [5.0, 0.004])
def test_pool_sums_are_made_by_columns(spark, half_life):
    """Several spans of a window, times of one instant, nulls, and decays whose weights no double spans at once."""
    import math

    day, rnd = 86_400.0, random.Random(3)
    rows = []
    for i in range(160):
        at = rnd.choice([rnd.uniform(0, 40), rnd.randrange(41), 20 + rnd.random() / 50])
        rows.append((i, rnd.choice(["p", "q", None]), round(at * 1e3) / 1e3 * day, rnd.choice(["a", "b", "c", None]), rnd.choice([0, 1, None]), rnd.randrange(9), rnd.choice([0, 1, 4]), rnd.randrange(9)))
    h = spark.createDataFrame(rows, "gameid long, player_id string, s double, champion string, result int, kills int, deaths int, assists int")
    h = h.withColumn("date", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    prior = spark.createDataFrame([("p", "a", 4.0, 3.0), ("p", "z", 2.0, 1.0), ("x", "a", 1.0, 1.0)], "player_id string, champion string, base_g double, base_w double")
    out = entity.player_store(h, prior, half_life=half_life, window=7, mastery_half_life=9)
    assert "MapInArrow" in plan(out)  # the product of times and pool goes into no window
    base = {("p", "a"): (4.0, 3.0), ("p", "z"): (2.0, 1.0)}
    want = {}
    pools = {"p": {"z"}, "q": set()}
    for r in rows:
        if r[1] and r[3]:
            pools[r[1]].add(r[3])
    pools["p"].add("a")

    def sums(p, c, t, life, window):
        s = [0.0, 0.0, 0.0, 0.0]
        n = 0
        for _, q, at, x, res, k, d, a in rows:
            if (q, x) == (p, c) and at < t and (window is None or at >= t - window * day):
                w = math.exp(-math.log(2) / life * (t - at) / day)
                s = [s[0] + w, s[1] + w * (res or 0), s[2] + w * (k + a), s[3] + w * d]
                n += 1
        return *s, n, [res for _, q, at, x, res, *_ in rows if (q, x) == (p, c) and at < t and (window is None or at >= t - window * day) and res is not None]

    for g, p, t, own, *_ in rows:
        for c in pools.get(p, ()):
            w, wr, ka, d, n, known = sums(p, c, t, half_life, 7)
            far = n and w < 1e-200  # weights that no double holds
            faint = far or 0 < d < 1e-200
            recent = (n, None if not n or not known or far else wr / w, None if not n or faint else ka / d if d > 0 else ka)
            w, wr, ka, d, n, known = sums(p, c, t, 9, None)
            bg, bw = base.get((p, c), (0.0, 0.0))
            rate = bw / bg if bg else 0.5
            if n and not known:
                score = None
            else:
                kda = 3.0 if not n else ka / d if d > 0 else ka
                score = ((wr + 3 * rate) / (w + 3) if n else rate) * 50 + min(math.log1p(bg + n) / math.log1p(50), 1) * 30 + min(kda, 8) / 8 * 20
            want[g, c] = (*recent, score, far, faint, None if own is None else own == c)
    got = {(r.gameid, r.champion): r for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 300
    for at, (n, wr, kda, score, far, faint, played) in want.items():
        r = got[at]
        assert (r.player_recent_games_90d, r.played) == (n, played), at
        assert r.mastery_score == (None if score is None else pytest.approx(score, rel=1e-9)), at
        if not far:
            assert r.player_recent_wr_90d == (None if wr is None else pytest.approx(wr, rel=1e-7)), at
        if not faint:
            assert r.player_recent_kda_90d == (None if kda is None else pytest.approx(kda, rel=1e-7)), at


def test_lineups_meet_their_tags_beside_the_wide_rows(spark):
    games = slots_game(spark, [1, 2, 2])
    tags = spark.createDataFrame([("blue_top_1", *range(7))], "champion string, " + ", ".join(f"{t} int" for t in derive.TAGS))
    wide = games.join(games.groupBy("gameid").agg(F.count("*").alias("n")), "gameid")
    a, b = (derive.derive_features(wide, tags, lineups=x) for x in (None, games))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert plan(b).count("SortMergeJoin") + plan(b).count("HashJoin") < plan(a).count("SortMergeJoin") + plan(a).count("HashJoin")


def test_items_of_a_day_are_made_where_they_are_emitted(spark, monkeypatch):
    import math

    from pitloom.operators import meta

    monkeypatch.setattr(meta, "_GAMES", 3)  # several blocks in a cell
    rnd = random.Random(4)
    g = [(i, rnd.choice([0, 0, 1, 3, None]), rnd.choice(["14.1", "14.2", "beta"])) for i in range(40)]
    picks = [(i, d, p, rnd.choice(["a", "b", "c", None]), rnd.choice([0, 1, None])) for i, d, p in g for _ in range(2)] + [(None, 1, "14.1", "b", 1)]
    bans = [(i, d, p, rnd.choice(["a", "d"])) for i, d, p in g if i % 3]
    df = lambda rows, more="": spark.createDataFrame(rows, f"gameid long, day int, patch string{more}")
    idx = {"14.1": 14 * 24 + 1, "14.2": 14 * 24 + 2, "beta": 0}
    pen = lambda p, q: max(math.exp(-0.5 * abs(idx[p] - idx[q])), 0.1)
    ev = [(i, d, p, c, (1, w or 0, 0)) for i, d, p, c, w in picks] + [(i, d, p, c, (0, 0, 1)) for i, d, p, c in bans]
    want = {}
    for i, d, p in g:
        if d is None:
            continue
        age = lambda day: math.exp(-math.log(2) / 7 * (d - day))
        earlier = lambda j, day: day is not None and (day < d or (day == d and (j is None or j < i)))
        slots = max(sum(pen(q, p) * age(day) for j, day, q in g if earlier(j, day)), 1.0)
        for c in "abcd":
            mine = [(pen(q, p) * age(day), x) for j, day, q, name, x in ev if name == c and earlier(j, day)]
            if mine:
                a, w, b = (sum(f * x[k] for f, x in mine) for k in range(3))
                want[i, c] = (a / slots, b / slots, (a + b) / slots, (w + 1) / (a + 2))
    for sub in (None, F.floor(F.col("gameid") / 8)):
        out = meta.meta_patch_weighted(df(picks, ", champion string, result int"), df(bans, ", champion string"), df(g), sub_bucket=sub)
        got = {(r.gameid, r.champion): tuple(r)[3:] for r in out.collect()}
        assert got.keys() == want.keys()
        for k, x in want.items():
            assert got[k] == pytest.approx(x, rel=1e-9), (sub, k)
        assert "MapInArrow" in plan(out)  # no row for a game and an item before the sweep
