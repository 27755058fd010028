"""Small frames with results worked out by hand, and brute force for the combinatorial rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pitloom.functions import columns as X
from pitloom.operators import draft, metrics, prep, quality, ranking, rates, rules
from pitloom.operators import reshape as rs
from pitloom.sources import matches, stores_io


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_percent_and_patch(spark):
    df = spark.createDataFrame([("53.2%",), ("0.53",), ("1%",), ("",), ("n/a",), (None,)], "s string")
    assert [r.v for r in df.select(X.parse_percent("s").alias("v")).collect()] == [pytest.approx(0.532), 0.53, 1.0, None, None, None]
    p = spark.createDataFrame([("14.1",), ("14.10",), ("beta",), (None,), ("14",)], "s string")
    assert [r.v for r in p.select(X.patch_index("s").alias("v")).collect()] == [337, 346, 0, 0, 0]


def test_wins_round_half_to_even(spark):
    assert one(spark, X.wins_from_rate(F.lit(0.5), F.lit(5))) == 2.0
    assert one(spark, X.wins_from_rate(F.lit(0.5), F.lit(7))) == 4.0


def test_lineup_feasible_equals_permutations(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.randrange(1, 32) for _ in range(rnd.randrange(0, 7))]) for i in range(300)]
    got = {r.i: r.ok for r in spark.createDataFrame(rows, "i int, m array<int>").select("i", X.lineup_feasible("m").alias("ok")).collect()}
    for i, masks in rows:
        want = any(all(m >> p & 1 for m, p in zip(masks, perm)) for perm in itertools.permutations(range(5), len(masks))) if len(masks) <= 5 else False
        assert got[i] == want


def test_pick_filter_moves_a_flex_champion(spark):
    pri = spark.createDataFrame(
        [(7, [0.9, 0.1, 0.0, 0.0, 0.0]), (8, [0.5, 0.5, 0.0, 0.0, 0.0]), (9, [0.95, 0.05, 0.0, 0.0, 0.0]), (10, [0.0, 0.0, 1.0, 0.0, 0.0]), (11, [0.0, 0.6, 0.4, 0.0, 0.0])],
        "candidate_id long, pos array<double>",
    )
    rows = spark.createDataFrame([(1, [7], c) for c in (8, 9, 10, 11)] + [(2, [], 9)], "q int, ally array<long>, candidate_id long")
    kept = {(r.q, r.candidate_id) for r in ranking.filter_pick_conflicts(rows, pri).collect()}
    assert kept == {(1, 8), (1, 10), (1, 11), (2, 9)}


def test_counter_directions_are_made_consistent(spark):
    df = spark.createDataFrame(
        [("a", "b", 0.6, 10, "easy", 1), ("b", "a", 0.6, 20, "easy", 2), ("c", "d", 0.55, 10, "easy", 3), ("d", "c", 0.45, 10, "hard", 4)],
        "champion string, opponent_name string, win_rate double, games int, matchup_type string, src long",
    )
    got = {(r.champion, r.opponent_name): (r.win_rate, r.matchup_type) for r in rates.counter_lookup(df).collect()}
    assert got[("a", "b")] == (round((8 + 1) / 22, 6), "hard")
    assert got[("b", "a")] == (round((12 + 1) / 22, 6), "easy")
    assert got[("c", "d")][1] == "easy" and got[("d", "c")][1] == "hard"


def test_psi_edges(spark):
    base = spark.createDataFrame([(float(i % 10), 1.0) for i in range(100)], "a double, flat double")
    b = quality.psi_baseline(base, ["a", "flat"])
    same = {r.feature: r.psi for r in quality.psi(b, base).collect()}
    assert same["a"] == pytest.approx(0.0) and same["flat"] == pytest.approx(0.0)
    away = {r.feature: r.psi for r in quality.psi(b, spark.createDataFrame([(99.0, None)], "a double, flat double")).collect()}
    assert away["a"] > 1 and away["flat"] == 1.0
    legacy = {r.feature: r.psi for r in quality.psi(b.withColumn("bin_edges", F.lit(None).cast("array<double>")), base, legacy=True).collect()}
    assert legacy["a"] == pytest.approx(0.0)


def test_exact_medians(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1.0, 2.0, 3.5, 9.0, None]), float(i)) for i in range(101)]
    m = prep.medians(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
    vals = sorted(x for x, _ in rows if x is not None)
    n = len(vals)
    assert m.a == (vals[(n - 1) // 2] + vals[n // 2]) / 2 and m.b == 50.0


def test_auc_with_ties_and_bootstrap(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(2), rnd.randrange(10) / 10) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.auc(df, "y", "p").first().auc == pytest.approx(want)
    ci = metrics.bootstrap_ci(df, "y", "p", n=100).first()
    assert ci.lower < want < ci.upper and ci.resamples == 100


def test_mirror_twice_is_the_identity(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 3.0, -1.0)], "id int, y int, blue_a double, red_a double, diff_a double")
    assert prep.mirror(prep.mirror(df, "y"), "y").collect() == df.collect()
    assert tuple(prep.mirror(df, "y").first()) == (1, 0, 3.0, 2.0, 1.0)


def test_rank_cells_equal_plain_ranks(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i % 3, i, float(rnd.randrange(20))) for i in range(200)], "q int, candidate_id int, s double")
    plain = sorted(tuple(r) for r in ranking.rank_map(df, "q", "s").select("q", "candidate_id", "rank").collect())
    cells = sorted(tuple(r) for r in ranking.rank_map(df, "q", "s", cells=7).select("q", "candidate_id", "rank").collect())
    assert plain == cells
    lone = ranking.rank_normalise(spark.createDataFrame([(1, 1, 2.0)], "q int, candidate_id int, s double"), "q", "s").first()
    assert lone.rn == 1.0


def test_dense_index_is_a_total_order(spark):
    rows = [(i, (i * 7) % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, day int")
    got = {r.id: r.match_seq_idx for r in matches.dense_index(df, ["day", "id"], [F.col("day"), F.floor(F.col("id") / 8)]).collect()}
    assert got == {i: n for n, (d, i) in enumerate(sorted((d, i) for i, d in rows))}


def test_routes_and_collapse(spark):
    s = spark.createDataFrame([(1, i, i / 100) for i in range(10)] + [(2, i, float(i)) for i in range(10)] + [(3, i, 0.0) for i in range(9)], "q int, candidate_id int, s double")
    got = {r.q: r.collapsed for r in rules.collapse_flag(s, "q", "s").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_draft_state_counts(spark):
    seq = list(range(10, 30))
    df = spark.createDataFrame([(1, seq, s) for s in (0, 6, 12, 19)], "gameid int, seq array<long>, step int")
    got = {r.step: r for r in draft.draft_state(df).collect()}
    assert got[0].ally == [] and got[0].ban_step == 1 and got[6].is_pick == 1
    assert len(got[12].banned) == 6 and len(got[19].unavailable) == 19 and got[19].side == "red"


def test_ranges_by_name():
    assert quality.feature_range("blue_top_mastery_score") == (0.0, 150.0)
    assert quality.feature_range("diff_team_recent_wr_5") == (-1.0, 1.0)
    assert quality.feature_range("unheard_of") == quality.ANY_RANGE


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, 0.5), ("a", "y", 2, float("nan")), ("b", "x", 3, 0.25)], "k1 string, k2 string, k3 int, rate double")
    stores_io.export_json(df, ["k1", "k2", "k3"], ["rate"], str(tmp_path / "j"))
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert text == ['{"a": {"x":{"1":{"rate":0.5}},"y":{"2":{"rate":null}}}}', '{"b": {"x":{"3":{"rate":0.25}}}}']
    log = spark.createDataFrame([(1, "2024-01-01 10:00:00", 0.5, 1), (2, "2024-01-03 10:00:00", 0.7, 0)], "request_id int, t string, f double, mask int")
    log = log.withColumn("timestamp", F.to_timestamp("t")).drop("t")
    stores_io.append_log(log, str(tmp_path / "log"), "m", 0)
    for _ in range(2):  # a batch that is written again replaces itself
        stores_io.append_candidate_log(log.withColumn("extra", F.lit(1)), str(tmp_path / "log"), "m", 1)
    back = stores_io.read_logs(spark, str(tmp_path / "log"), "m", 3, "2024-01-03")
    assert sorted((r.request_id, r.extra) for r in back.collect() if r.extra) == [(1, 1.0)] and back.count() == 3
    assert stores_io.read_logs(spark, str(tmp_path / "log"), "m", 2, "2024-01-03").count() == 1
    assert matches.load_career(spark, str(tmp_path / "none.csv")).count() == 0
    stores_io.save_store(df, str(tmp_path / "s"), ["k1"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3 and matches.discover(spark, str(tmp_path / "s/*/*.parquet")).count() >= 2


def test_vocab_and_prior_files(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"name_to_idx": {"A": 7,\n "B": 8}}')
    (tmp_path / "p.json").write_text('{"A": {"top": 0.9,\n "mid": 0.1}}')
    assert {tuple(r) for r in matches.load_vocab(spark, str(tmp_path / "v.json")).collect()} == {("A", 7), ("B", 8)}
    assert {tuple(r) for r in matches.load_position_prior(spark, str(tmp_path / "p.json")).collect()} == {("A", "top", 0.9), ("A", "mid", 0.1)}


def test_udf_helpers(spark):
    from pitloom.functions import udfs

    df = spark.createDataFrame([(1, [5, 6]), (2, [7])], "g int, seq array<bigint>")
    fn = udfs.unroll_udtf()
    spark.udtf.register("unroll", fn)
    df.createOrReplaceTempView("seqs")
    got = spark.sql("SELECT g, step, target, size(prefix) AS n FROM seqs, LATERAL unroll(seq)").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 5, 0), (1, 1, 6, 1), (2, 0, 7, 0)]
    spread = udfs.aggregate(lambda x: float(x.max() - x.min()), "double")
    assert spark.range(5).agg(spread(F.col("id").cast("double")).alias("v")).first().v == 4.0


def test_bootstrap_covers_close_scores_and_heavy_cells(spark):
    rows = [(1, 0.50002 + i * 4e-5) for i in range(5)] + [(0, 0.5 + i * 1e-6) for i in range(5)]
    ci = metrics.bootstrap_ci(spark.createDataFrame(rows, "y int, p double"), "y", "p", n=100).first()
    assert ci.lower == ci.upper == 1.0
    many = spark.createDataFrame([(i % 2, float(i % 4)) for i in range(4000)], "y int, p double")
    ci = metrics.bootstrap_ci(many, "y", "p", n=200).first()
    assert ci.lower <= metrics.auc(many, "y", "p").first().auc <= ci.upper and ci.upper - ci.lower < 0.06


def test_auc_of_raw_logits(spark):
    rows = [(int(i % 3 == 0), (-1) ** i * float(i) ** 3) for i in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(metrics.auc(spark.createDataFrame(rows, "y int, p double"), "y", "p").first().auc - want) < 1e-12


def test_rule_ban_answers_unknown_players(spark):
    from pitloom.operators import rules

    q = spark.createDataFrame([(1, "a", [2]), (2, "nobody", [1]), (3, None, [])], "query_id int, player_id string, unavailable array<int>")
    meta = spark.createDataFrame([(1, 0.5, 0.6), (2, 0.4, 0.4), (3, 0.1, 0.55)], "candidate_id int, presence double, meta_wr double")
    mastery = spark.createDataFrame([("a", 1, 80.0), ("a", 3, 20.0)], "player_id string, candidate_id int, mastery double")
    got = {}
    for r in rules.rule_ban(q, meta, mastery).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.candidate_id)
    assert got == {1: [1, 3], 2: [2, 3], 3: [1, 2, 3]}


def test_ranges_by_whole_name(spark):
    from pitloom.operators import quality

    df = spark.createDataFrame([(1.5, 0.5, 5e4)], "grudge double, is_pick double, other double")
    found = quality.validate_ranges(df, df.columns, quality.CANDIDATE_RANGES, whole_names=True)
    assert sorted(r.feature for r in found.collect()) == ["grudge", "other"]
    assert quality.feature_range("tf_win_logits") == (-100.0, 100.0) and quality.feature_range("diff_wr_x_aggression") == (-40.0, 40.0)


def test_names_that_contain_each_other(spark):
    import random

    from pitloom.operators.reshape import resolve_names

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abAB c") for _ in range(n))
    known = sorted({word(r.randint(1, 8)) for _ in range(60)} | {"T1", "aa", "Team Alpha"})
    names = [word(r.randint(1, 12)) for _ in range(150)] + ["t1", " the team alpha x", "", None, "q", "zzz", "TEAM"] + known[:5]
    alias = {"q": "Quorum"}
    got = resolve_names(
        spark.createDataFrame([(n,) for n in names], "n string"),
        "n",
        spark.createDataFrame([(k,) for k in known], "team string"),
        spark.createDataFrame(list(alias.items()), "alias string, team string"),
    ).collect()

    def want(n):
        if n is None or n in known:
            return n
        k = n.strip(" ").lower()
        if k in alias or not k:
            return alias.get(k)
        return min((t for t in known if k in t.lower() or t.lower() in k), key=lambda t: (len(t), t), default=None)

    assert len(got) == len(names) and {x.n: x.resolved for x in got} == {n: want(n) for n in names}
