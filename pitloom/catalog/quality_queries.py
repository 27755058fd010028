"""Queries for checks, drift, alignment, metrics and attribution (families L, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitloom.catalog import inputs as I
from pitloom.catalog import query
from pitloom.catalog import reshaping as RS
from pitloom.catalog.inputs import with_inputs
from pitloom.operators import derive as D
from pitloom.operators import metrics as M
from pitloom.operators import quality as Q
from pitloom.operators import reshape as rs


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query(
    "check_table",
    "WITH t AS (SELECT l_suppkey, nullif(l_returnflag, 'R') AS l_returnflag, l_extendedprice * 20 AS price FROM lineitem), d AS (SELECT CAST(sum(k - 1) AS BIGINT) AS d FROM (SELECT count(*) AS k FROM t GROUP BY ALL l_suppkey, l_returnflag, price)) "
    "SELECT 1".replace("GROUP BY ALL ", "GROUP BY ")
    .replace(
        "SELECT 1",
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count({c}) = 0 AS all_null, 0 AS inf, {e} AS extreme, (SELECT d FROM d) AS duplicate_rows FROM t"
            for c, e in {"l_suppkey": "count(CASE WHEN abs(l_suppkey) > 1e6 THEN 1 END)", "l_returnflag": "0", "price": "count(CASE WHEN abs(price) > 1e6 THEN 1 END)"}.items()
        ),
    ),
)
def check_table(spark, sf):
    t = I.table(spark, sf, "lineitem").selectExpr("l_suppkey", "nullif(l_returnflag, 'R') AS l_returnflag", "l_extendedprice * 20 AS price")
    return Q.check_table(t)


@query(
    "check_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 0 AS nan, 0 AS inf, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, count(CASE WHEN {c} < 1 OR {c} > 30 THEN 1 END) AS out_of_range, 0 AS extreme FROM lineitem"
        for c in ("l_quantity", "l_discount")
    ),
)
def check_columns(spark, sf):
    return Q.check_columns(I.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], 1, 30).withColumn("mean", r("mean", 4))


@query(
    "check_labels",
    "SELECT toxic, n, round(n / sum(n) OVER (), 6) AS share, count(*) OVER () = 1 AS single_class, count(*) OVER () > 1 AND min(n) OVER () / sum(n) OVER () < 0.01 AS imbalanced FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)",
)
def check_labels(spark, sf):
    return Q.check_labels(I.table(spark, sf, "labels"), "toxic").withColumn("share", r("share"))


@query(
    "check_groups",
    "SELECT count(*) AS groups, min(n) AS smallest, max(n) AS largest, count(CASE WHEN n > 500 THEN 1 END) AS too_big, CAST(sum(n) AS BIGINT) AS total, sum(n) = (SELECT count(*) FROM lineitem) AS total_matches FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)",
)
def check_groups(spark, sf):
    return Q.check_groups(I.table(spark, sf, "lineitem"), "l_suppkey")


@query("check_predictions", with_inputs("SELECT 0 AS nan, 0 AS inf, min(p) AS min, max(p) AS max, stddev_pop(p) < 1e-8 AS constant FROM preds", "preds"))
def check_predictions(spark, sf):
    return Q.check_predictions(I.preds(spark, sf), "p")


_RNG = ["league_x", "team_avg_ckpm", "diff_team_recent_wr", "plain"]
_RNGX = {"league_x": "l_discount * 15", "team_avg_ckpm": "l_quantity / 8", "diff_team_recent_wr": "l_tax * 30 - 1.5", "plain": "l_extendedprice / 10"}
_RNGB = {"league_x": (0.0, 1.0), "team_avg_ckpm": (0.0, 5.0), "diff_team_recent_wr": (-1.0, 1.0), "plain": (-10000.0, 10000.0)}


@query(
    "validate_ranges",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS feature, round({_RNGX[c]}, 6) AS value, CAST({_RNGB[c][0]} AS DOUBLE) AS lo, CAST({_RNGB[c][1]} AS DOUBLE) AS hi FROM lineitem WHERE {_RNGX[c]} < {_RNGB[c][0]} OR {_RNGX[c]} > {_RNGB[c][1]}"
        for c in _RNG
    ),
)
def validate_ranges(spark, sf):
    t = I.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {c}" for c, e in _RNGX.items()])
    return Q.validate_ranges(t, _RNG, keys=["l_orderkey", "l_linenumber"]).withColumn("value", r("value"))


@query(
    "validate_integrity",
    "SELECT count(*) AS rows, 0 AS non_finite, count(CASE WHEN l_discount = 0 AND l_tax = 0 THEN 1 END) AS zero_rows, 1 AS zero_columns, count(CASE WHEN l_linenumber NOT IN (0, 1) THEN 1 END) AS non_binary, true AS columns_match, false AS order_match FROM lineitem",
)
def validate_integrity(spark, sf):
    t = I.table(spark, sf, "lineitem").withColumn("z", F.lit(0.0))
    return Q.validate_integrity(t, ["l_discount", "l_tax", "z"], ["z", "l_discount", "l_tax"], ["l_linenumber"])


# ---- drift: baseline = first half of the events ----
_EVH = "SELECT *, ts < (SELECT min(ts) + INTERVAL 15 DAY FROM events) AS old FROM events"
_BINC = "CASE WHEN value BETWEEN lo AND hi THEN least(CAST(floor((value - lo) / (hi - lo) * 10) AS BIGINT), 9) END"


def halves(spark, sf):
    e = I.table(spark, sf, "events")
    cut = e.agg((F.min("ts") + F.expr("INTERVAL 15 DAYS")).alias("c")).scalar()
    e = e.withColumn("half", F.floor(F.col("event_id") % 1000 / 10).cast("double"))
    return e.filter(F.col("ts") < cut).select("event_type", "value", "half"), e.filter(F.col("ts") >= cut).select("event_type", "value", "half")


_PSIX = "SELECT event_type, old, 'value' AS feature, value FROM h UNION ALL SELECT event_type, old, 'half', CAST(floor(event_id % 1000 / 10) AS DOUBLE) FROM h"
_SPAN = "SELECT feature, min(value) AS lo, max(value) AS hi FROM x WHERE old GROUP BY 1"


@query(
    "psi_baseline",
    f"WITH h AS ({_EVH}), x AS ({_PSIX}), s AS ({_SPAN}), n AS (SELECT feature, {_BINC} AS b, count(*) AS c FROM x JOIN s USING (feature) WHERE old GROUP BY 1, 2) "
    "SELECT feature, b AS bin, CAST(c AS DOUBLE) AS n FROM n",
)
def psi_baseline(spark, sf):
    b = Q.psi_baseline(halves(spark, sf)[0], ["value", "half"])
    return b.select("feature", F.posexplode("counts").alias("bin", "n")).filter("n > 0")


def _psi_sql(edges_from_current=False, by=False):
    g = "event_type, " if by else ""
    span = "s2" if edges_from_current else "s"
    cur = f"SELECT {g}feature, {_BINC} AS b, count(*) AS c FROM x JOIN {span} USING (feature) WHERE NOT old GROUP BY ALL"
    keys = "(SELECT DISTINCT event_type FROM x), (SELECT unnest(['value', 'half']) AS feature)" if by else "(SELECT unnest(['value', 'half']) AS feature)"
    on = "c.event_type = k.event_type AND " if by else ""
    return (
        f"WITH h AS ({_EVH}), x AS ({_PSIX}), s AS ({_SPAN}), s2 AS ({_SPAN.replace('WHERE old', 'WHERE NOT old')}), "
        f"bn AS (SELECT feature, {_BINC} AS b, count(*) AS c FROM x JOIN s USING (feature) WHERE old GROUP BY 1, 2), cn0 AS ({cur}), cn AS (SELECT * FROM cn0 WHERE b IS NOT NULL), "
        f"bt AS (SELECT feature, sum(c) AS t FROM bn GROUP BY 1), ct AS (SELECT {g}feature, sum(c) AS t FROM cn GROUP BY ALL), nn AS (SELECT {g}feature, count(*) AS n FROM x WHERE NOT old GROUP BY ALL), "
        f"k AS (SELECT * FROM {keys}, (SELECT unnest(range(10)) AS b)) "
        f"SELECT {'k.event_type, ' if by else ''}k.feature, any_value(nn.n) AS n, round(sum((greatest(coalesce(c.c, 0) / ct.t, 1e-6) - greatest(coalesce(bn.c, 0) / bt.t, 1e-6)) * ln(greatest(coalesce(c.c, 0) / ct.t, 1e-6) / greatest(coalesce(bn.c, 0) / bt.t, 1e-6))), 6) AS psi "
        f"FROM k JOIN bt ON bt.feature = k.feature LEFT JOIN bn ON bn.feature = k.feature AND bn.b = k.b LEFT JOIN cn c ON {on}c.feature = k.feature AND c.b = k.b "
        f"JOIN ct ON {'ct.event_type = k.event_type AND ' if by else ''}ct.feature = k.feature JOIN nn ON {'nn.event_type = k.event_type AND ' if by else ''}nn.feature = k.feature GROUP BY {'k.event_type, ' if by else ''}k.feature"
    )


@query("psi", _psi_sql())
def psi(spark, sf):
    old, new = halves(spark, sf)
    return Q.psi(Q.psi_baseline(old, ["value", "half"]), new.drop("event_type")).withColumn("psi", r("psi"))


@query("psi_without_edges", _psi_sql(edges_from_current=True))
def psi_without_edges(spark, sf):
    """A baseline of counts only, as older ones are: the current values' own range is cut into bins."""
    old, new = halves(spark, sf)
    base = Q.psi_baseline(old, ["value", "half"]).withColumn("bin_edges", F.lit(None).cast("array<double>"))
    return Q.psi(base, new.drop("event_type"), legacy=True).withColumn("psi", r("psi"))


@query("psi_by_segment", _psi_sql(by=True))
def psi_by_segment(spark, sf):
    old, new = halves(spark, sf)
    return Q.psi(Q.psi_baseline(old, ["value", "half"]), new, ["event_type"]).withColumn("psi", r("psi"))


@query(
    "drift_report",
    f"SELECT event_type, count(*) AS compared, count(CASE WHEN psi >= 0.005 THEN 1 END) AS n_drifted, max(psi) AS max_psi, coalesce(string_agg(feature, ',' ORDER BY psi DESC, feature) FILTER (WHERE psi >= 0.005), '') AS drifted, CASE WHEN max(psi) < 0.1 THEN 'stable' WHEN max(psi) < 0.25 THEN 'moderate' ELSE 'significant' END AS band FROM ({_psi_sql(by=True)}) GROUP BY 1",
)
def drift_report(spark, sf):
    old, new = halves(spark, sf)
    p = Q.psi(Q.psi_baseline(old, ["value", "half"]), new, ["event_type"]).withColumn("psi", r("psi"))
    return Q.drift_report(p, ["event_type"], 0.005).withColumn("drifted", F.array_join("drifted", ","))


@query(
    "sample_cap",
    "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || event_id::VARCHAR), 1, 15))::BIGINT, event_id) AS rn FROM events) WHERE rn <= 500",
)
def sample_cap(spark, sf):
    return Q.sample_cap(I.table(spark, sf, "events").select("event_id", "event_type", "value"), 500, ["event_id"])


@query(
    "align_tables",
    "SELECT 'x' AS \"column\", count(*) - count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) AS compared, CAST(0.001 AS DOUBLE) AS max_diff, count(CASE WHEN o_orderkey % 50 = 0 THEN 1 END) AS one_sided, 0.0001::DOUBLE AS tolerance, false AS aligned FROM orders "
    "UNION ALL SELECT 'y', count(*), CAST(0.5 AS DOUBLE), 0, CAST(1.0 AS DOUBLE), true FROM orders",
)
def align_tables(spark, sf):
    o = I.table(spark, sf, "orders")
    a = o.selectExpr("o_orderkey", "CAST(o_custkey AS DOUBLE) AS x", "CAST(o_custkey AS DOUBLE) AS y")
    b = o.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_custkey + 0.001D ELSE o_custkey END AS x", "o_custkey + 0.5D AS y")
    return Q.align_tables(a, b, ["o_orderkey"], fuzzy={"y": 1.0}).withColumn("max_diff", r("max_diff"))


@query(
    "align_predictions",
    with_inputs(
        "SELECT count(*) AS total, round(avg(d), 8) AS mean_diff, round(max(d), 8) AS max_diff, count(CASE WHEN d >= 1e-6 THEN 1 END) AS mismatch, count(CASE WHEN d >= 1e-4 THEN 1 END) AS far_off, true AS passed "
        "FROM (SELECT CASE WHEN row_id % 11 = 0 THEN 0.00005::DOUBLE ELSE 0.0::DOUBLE END AS d FROM preds)",
        "preds",
    ),
)
def align_predictions(spark, sf):
    p = I.preds(spark, sf).select("row_id", "p")
    q = p.withColumn("p", F.when(F.col("row_id") % 11 == 0, F.col("p") + 5e-5).otherwise(F.col("p")))
    return Q.align_predictions(p, q, ["row_id"]).drop("std_diff").withColumns({"mean_diff": r("mean_diff", 8), "max_diff": r("max_diff", 8)})


_AVGR = "rank() OVER (PARTITION BY query_id ORDER BY {c}) + (count(*) OVER (PARTITION BY query_id, {c}) - 1) / 2"
_POS = "row_number() OVER (PARTITION BY query_id ORDER BY {c} DESC, candidate_id)"


@query(
    "align_rankings",
    with_inputs(
        "SELECT *, CASE WHEN spearman > 0.99 AND top1_match THEN 'pass' WHEN spearman > 0.95 AND overlap >= depth * 0.8 THEN 'acceptable' ELSE 'mismatch' END AS verdict FROM ("
        "SELECT query_id, round(corr(ra, rb), 5) AS spearman, count(CASE WHEN pa <= 20 AND pb <= 20 THEN 1 END) AS overlap, least(20, count(*)) AS depth, count(CASE WHEN pa = 1 AND pb = 1 THEN 1 END) = 1 AS top1_match, "
        "min(CASE WHEN label = 1 THEN pa END) AS label_rank_a, min(CASE WHEN label = 1 THEN pb END) AS label_rank_b FROM ("
        f"SELECT query_id, label, {_AVGR.format(c='cs_logit')} AS ra, {_AVGR.format(c='nocs_logit')} AS rb, {_POS.format(c='cs_logit')} AS pa, {_POS.format(c='nocs_logit')} AS pb FROM scores) GROUP BY 1)",
        "scores",
    ),
)
def align_rankings(spark, sf):
    return Q.align_rankings(I.scores(spark, sf), "query_id", "cs_logit", "nocs_logit", "candidate_id", 20, "label").withColumn("spearman", r("spearman", 5))


# ---- metrics ----
_BESTR = f"SELECT query_id, query_id % 20 AS step, CASE WHEN query_id % 20 < 12 THEN 1 ELSE 2 END AS phase, min(CASE WHEN label = 1 THEN rk END) AS b FROM (SELECT query_id, label, {_POS.format(c='cs_logit')} AS rk FROM scores) GROUP BY 1"


def best_ranks(spark, sf):
    from pitloom.operators.ranking import rank_map

    ranked = rank_map(I.scores(spark, sf), "query_id", "cs_logit")
    b = M.positive_rank(ranked, ["query_id"], "label")
    return b.withColumns({"step": F.col("query_id") % 20, "phase": F.when(F.col("query_id") % 20 < 12, 1).otherwise(2)})


_HITS = "count(*) AS queries, " + ", ".join(f"round(avg(CASE WHEN b <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}" for k in (1, 5, 10, 50)) + ", round(avg(CASE WHEN b <= 20 THEN 1.0 / b ELSE 0.0 END), 6) AS mrr"


@query("hit_at_k_and_mrr", with_inputs(f"SELECT phase, step, {_HITS} FROM bb GROUP BY GROUPING SETS ((), (phase), (step))", "scores", bb=_BESTR))
def hit_at_k_and_mrr(spark, sf):
    h = M.hit_at_k(best_ranks(spark, sf), [1, 5, 10, 50], [[], ["phase"], ["step"]])
    return h.select("phase", "step", "queries", *[r(c).alias(c) for c in h.columns if c.startswith(("hit", "mrr"))])


@query("lowest_steps", with_inputs(f"SELECT step, round(avg(CASE WHEN b <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10 FROM bb GROUP BY 1 ORDER BY avg(CASE WHEN b <= 10 THEN 1.0 ELSE 0.0 END), step LIMIT 3", "scores", bb=_BESTR))
def lowest_steps(spark, sf):
    h = M.hit_at_k(best_ranks(spark, sf), [10], [["step"]]).select("step", r("hit_at_10").alias("hit_at_10"))
    return M.lowest(h, "hit_at_10", ["step"])


_AUC = (
    "SELECT {g}round((sum(CASE WHEN y = 1 THEN rk END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1) / 2.0) / (count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END)), 6) AS auc{x} FROM ("
    "SELECT *, rank() OVER ({p}ORDER BY p) + (count(*) OVER (PARTITION BY {q}p) - 1) / 2 AS rk FROM preds)"
)


@query("auc", with_inputs(_AUC.format(g="", x="", p="", q=""), "preds"))
def auc(spark, sf):
    return M.auc(I.preds(spark, sf), "y", "p").select(r("auc").alias("auc"))


_LOSS = "round(avg(-(y * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)))), 5) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy"


@query("losses", with_inputs(f"SELECT fold, count(*) AS n, {_LOSS} FROM preds GROUP BY fold", "preds"))
def losses(spark, sf):
    out = M.losses(I.preds(spark, sf), "y", "p", ["fold"])
    return out.select("fold", "n", r("log_loss", 5).alias("log_loss"), r("brier").alias("brier"), r("accuracy").alias("accuracy"))


@query(
    "segment_metrics",
    with_inputs(
        f"SELECT * FROM (SELECT segment, count(*) AS n, {_LOSS} FROM preds GROUP BY segment HAVING count(*) >= 10) JOIN ({_AUC.format(g='segment, ', x='', p='PARTITION BY segment ', q='segment, ')} GROUP BY segment) USING (segment)", "preds"
    ),
)
def segment_metrics(spark, sf):
    out = M.segment_metrics(I.preds(spark, sf), "segment", "y", "p")
    return out.select("segment", "n", r("log_loss", 5).alias("log_loss"), r("brier").alias("brier"), r("accuracy").alias("accuracy"), r("auc").alias("auc"))


def _mix_sql(x: str) -> str:
    """SQL of the number mixer of the bootstrap, on 64-bit numbers held as UBIGINT."""
    times = lambda x, m: f"(({x})::UHUGEINT * {m}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    for shift, m in ((30, M._MIX[0]), (27, M._MIX[1])):
        x = times(f"xor({x}, ({x}) >> {shift})", m)
    return f"xor({x}, ({x}) >> 31)"


_STARTED = f"(((start_::UHUGEINT + r::UHUGEINT * {M._STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"


@query(
    "bootstrap_ci",
    with_inputs(
        "SELECT round(quantile_cont(a, 0.025), 6) AS lower, round(quantile_cont(a, 0.975), 6) AS upper, round(avg(a), 6) AS mean, count(a) AS resamples FROM ("
        "SELECT r, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS a FROM ("
        "SELECT r, p, pos, neg, sum(neg) OVER (PARTITION BY r ORDER BY p) - neg AS below FROM b) GROUP BY r)",
        "preds",
        cells="SELECT y, p, count(*) AS c FROM preds GROUP BY 1, 2",
        parts=f"SELECT y, p, j, least({M._MEAN}, c - {M._MEAN} * j) AS m, ('0x' || substr(md5('42:' || y || ':' || CAST(floor(p * 1099511627776) AS BIGINT) || ':' || j), 1, 16))::UBIGINT AS start_ "
        f"FROM (SELECT y, p, c, unnest(range(CAST(ceil(c / {M._MEAN}.0) AS BIGINT))) AS j FROM cells)",
        draws="SELECT y, p, r, m, (" + _mix_sql("key") + " >> 12)::DOUBLE * pow(2.0, -52) AS u FROM (SELECT y, p, m, r, " + _STARTED + " AS key FROM (SELECT *, unnest(range(200)) AS r FROM parts))",
        terms=f"SELECT m, k, exp(-m) * pow(m, k) / gamma(k + 1) AS term FROM (SELECT unnest(range(1, {M._MEAN + 1})) AS m), (SELECT unnest(range(60)) AS k)",
        levels="SELECT m, list(cdf ORDER BY k) AS cdfs FROM (SELECT m, k, sum(term) OVER (PARTITION BY m ORDER BY k) AS cdf FROM terms) GROUP BY m",
        b="SELECT r, p, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y <> 1), 0) AS neg FROM (SELECT r, p, y, len(list_filter(cdfs, lambda x: x <= u)) AS w FROM draws JOIN levels USING (m)) GROUP BY 1, 2",
    ),
)
def bootstrap_ci(spark, sf):
    out = M.bootstrap_ci(I.preds(spark, sf), "y", "p", n=200)
    return out.select(r("lower").alias("lower"), r("upper").alias("upper"), r("mean").alias("mean"), "resamples")


@query(
    "fold_summary",
    with_inputs(
        "SELECT segment, round(avg(b), 6) AS mean, round(stddev_pop(b), 6) AS std, round(avg(b) - 0.3, 6) AS delta, CASE WHEN avg(b) - 0.3 > 0.005 THEN 'better' WHEN avg(b) - 0.3 < -0.005 THEN 'worse' ELSE 'same' END AS verdict, "
        "round(avg(CASE WHEN fold > 2 THEN b END) - avg(CASE WHEN fold <= 2 THEN b END), 6) + 0.0 AS late_minus_early FROM (SELECT segment, fold, avg(pow(p - y, 2)) AS b FROM preds GROUP BY 1, 2) GROUP BY 1",
        "preds",
    ),
)
def fold_summary(spark, sf):
    per = M.losses(I.preds(spark, sf), "y", "p", ["segment", "fold"])
    out = M.fold_summary(per, "brier", "fold", 0.3, by=["segment"])
    return out.select("segment", r("mean").alias("mean"), r("std").alias("std"), r("delta").alias("delta"), "verdict", (r("late_minus_early") + 0.0).alias("late_minus_early"))


_TG = [0.5 + 2.5 * i / 10 for i in range(11)]


@query(
    "temperature_scaling",
    with_inputs(
        "SELECT round(t, 6) AS t, round(nll, 6) AS nll, nll = (SELECT min(nll) FROM n) AS best FROM n",
        "preds",
        g="SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in _TG) + "]) AS t",
        z="SELECT y, ln(greatest(least(p, 1 - 1e-12), 1e-12) / (1 - greatest(least(p, 1 - 1e-12), 1e-12))) AS z FROM preds",
        q="SELECT t, y, greatest(least(1 / (1 + exp(-z / t)), 1 - 1e-12), 1e-12) AS q FROM z, g",
        n="SELECT t, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS nll FROM q GROUP BY t",
    ),
)
def temperature_scaling(spark, sf):
    return M.temperature(I.preds(spark, sf), "y", "p", steps=11).select(r("t").alias("t"), r("nll").alias("nll"), "best")


@query(
    "ensemble_prob",
    with_inputs(
        "SELECT id, round(avg(m), 6) AS prob, round(stddev_pop(m), 6) AS fold_std, CASE WHEN abs(2 * avg(m) - 1) < 0.1 THEN 'even' WHEN avg(m) > 0.5 THEN 'blue' ELSE 'red' END AS verdict FROM ("
        "SELECT row_id % 97 AS id, fold, avg(p) AS m FROM preds GROUP BY 1, 2) GROUP BY 1",
        "preds",
    ),
)
def ensemble_prob(spark, sf):
    p = I.preds(spark, sf).withColumn("id", F.col("row_id") % 97)
    return M.ensemble_prob(p, ["id"], "fold", "p").select("id", r("prob").alias("prob"), r("fold_std").alias("fold_std"), "verdict")


@query(
    "draft_delta",
    with_inputs(
        "SELECT row_id, round(d, 6) + 0.0 AS delta, CASE WHEN d > 0.005 THEN 'blue' WHEN d < -0.005 THEN 'red' ELSE 'even' END AS direction, "
        "CASE WHEN abs(d) >= 0.1 THEN 'huge' WHEN abs(d) >= 0.05 THEN 'significant' WHEN abs(d) >= 0.02 THEN 'moderate' ELSE 'slight' END AS impact FROM (SELECT row_id, p - (p * 0.8 + 0.09) AS d FROM preds)",
        "preds",
    ),
)
def draft_delta(spark, sf):
    p = I.preds(spark, sf).withColumn("pre", F.col("p") * 0.8 + 0.09)
    return M.draft_delta(p, "pre", "p").select("row_id", (r("delta") + 0.0).alias("delta"), "direction", "impact")


_IMP = "CASE event_id % 4 WHEN 0 THEN 'comp_a' WHEN 1 THEN 'blue_mastery_score' WHEN 2 THEN 'team_recent_wr' ELSE 'league_x' END"


@query(
    "importance_share",
    f"SELECT CASE WHEN f LIKE 'comp%' OR f LIKE '%mastery%' THEN 'draft' ELSE 'hard' END AS family, count(*) AS features, round(sum(v) / (SELECT sum(value) FROM events), 6) AS share FROM (SELECT {_IMP} AS f, sum(value) AS v FROM events GROUP BY 1) GROUP BY 1",
)
def importance_share(spark, sf):
    e = I.table(spark, sf, "events").selectExpr(f"{_IMP} AS feature", "value").groupBy("feature").agg(F.sum("value").alias("importance"))
    return M.importance_share(e, rs.DRAFT_KEYWORDS).withColumn("share", r("share"))


_CON = "SELECT user_id AS row_id, event_type AS feature, CAST(CAST(sum(event_id % 201) AS BIGINT) % 401 - 200 AS DOUBLE) / 97 AS contribution, 0.25 AS base_value FROM events GROUP BY 1, 2"


def contributions(spark, sf):
    e = I.table(spark, sf, "events").groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("feature"))
    return e.agg(((F.sum(F.col("event_id") % 201) % 401 - 200).cast("double") / 97).alias("contribution")).withColumn("base_value", F.lit(0.25))


def _waterfall_sql(base):
    return (
        "SELECT row_id, position, feature, round(contribution, 6) AS contribution, direction, round(bar, 4) AS bar_pct, round((1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - contribution)))) * 100, 5) + 0.0 AS prob_delta FROM ("
        f"SELECT *, {base} + sum(contribution) OVER (PARTITION BY row_id ORDER BY position) AS z, abs(contribution) / max(abs(contribution)) OVER (PARTITION BY row_id) * 100 AS bar FROM ("
        "SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY sg DESC, abs(contribution) DESC, feature) AS position, CASE WHEN sg = 1 THEN 'positive' ELSE 'negative' END AS direction FROM ("
        "SELECT *, row_number() OVER (PARTITION BY row_id, sg ORDER BY abs(contribution) DESC, feature) AS rn FROM (SELECT *, CASE WHEN contribution > 1e-6 THEN 1 WHEN contribution < -1e-6 THEN -1 END AS sg FROM c) WHERE sg IS NOT NULL) WHERE rn <= 2))"
    )


def _wf(df):
    return df.select(
        "row_id", "position", "feature", r("contribution").alias("contribution"), "direction", r("bar_pct", 4).alias("bar_pct"), (r("prob_delta", 5) + 0.0).alias("prob_delta")
    )


@query("contribution_waterfall", f"WITH c AS ({_CON}) " + _waterfall_sql("base_value"))
def contribution_waterfall(spark, sf):
    return _wf(M.waterfall(contributions(spark, sf), "row_id", 2))


@query(
    "contribution_waterfall_calibrated",
    f"WITH c0 AS ({_CON}), s AS (SELECT row_id, ln(((row_id % 9 + 1) / 11.0) / (1 - (row_id % 9 + 1) / 11.0)) - 0.25 - sum(contribution) AS d FROM c0 GROUP BY 1), c AS (SELECT c0.*, s.d FROM c0 JOIN s USING (row_id)) " + _waterfall_sql("0.25 + d"),
)
def contribution_waterfall_calibrated(spark, sf):
    c = contributions(spark, sf)
    t = c.select("row_id").distinct().withColumn("target_prob", (F.col("row_id") % 9 + 1) / 11)
    return _wf(M.waterfall(c, "row_id", 2, t))


@query(
    "lane_matchups",
    with_inputs(
        "SELECT gameid, count(CASE WHEN w > 0.52 THEN 1 END) AS blue_lanes, count(CASE WHEN w < 0.48 THEN 1 END) AS red_lanes, "
        "CASE WHEN count(CASE WHEN w > 0.52 THEN 1 END) > count(CASE WHEN w < 0.48 THEN 1 END) THEN 'blue' WHEN count(CASE WHEN w < 0.48 THEN 1 END) > count(CASE WHEN w > 0.52 THEN 1 END) THEN 'red' ELSE 'even' END AS advantage FROM ("
        "SELECT l.gameid, round(coalesce(y.wr, 1 - ry.wr), 6) AS w FROM l LEFT JOIN y ON y.champion = l.a AND y.opponent_name = l.b LEFT JOIN y ry ON ry.champion = l.b AND ry.opponent_name = l.a) GROUP BY 1",
        "games",
        "pairs",
        l=RS.LANES_SQL,
        p=RS.PAIR_RATE,
        y="SELECT champion, opponent_name, arg_max(wr, CAST(games AS BIGINT) * 1000000000 - src) AS wr FROM p GROUP BY 1, 2",
    ),
)
def lane_matchups(spark, sf):
    from pitloom.functions.columns import parse_percent
    from pitloom.operators import lookups

    p = I.pairs(spark, sf).withColumn("win_rate", parse_percent("win_rate")).filter("win_rate is not null").withColumn("position", F.lit("any"))
    lanes = lookups.lookup_matchup(RS.lanes(spark, sf), p, order=[F.col("games"), -F.col("src")])
    return M.lane_tally(lanes.withColumn("verdict", M.lane_verdict(F.round("win_rate", 6))), "gameid")


@query(
    "lineup_synergies",
    with_inputs(
        "SELECT g.gameid, count(*) AS pairs, round(sum(s.wr) + 1e-9, 5) AS wr_sum FROM pr g JOIN s ON s.x = least(g.a, g.b) AND s.y = greatest(g.a, g.b) WHERE s.wr > 0.45 AND s.games >= 3 GROUP BY 1",
        "games",
        "pairs",
        p=RS.PAIR_RATE,
        pr=" UNION ALL ".join(f"SELECT gameid, blue_{rs.ROLES[i]}_champion AS a, blue_{rs.ROLES[j]}_champion AS b FROM games" for i in range(5) for j in range(i + 1, 5)),
        s="SELECT least(champion, opponent_name) AS x, greatest(champion, opponent_name) AS y, arg_min(wr, src) AS wr, arg_min(games, src) AS games FROM p GROUP BY 1, 2",
    ),
)
def lineup_synergies(spark, sf):
    from pitloom.functions.columns import parse_percent

    p = I.pairs(spark, sf).withColumn("win_rate", parse_percent("win_rate")).filter("win_rate is not null")
    one = p.groupBy(F.least("champion", "opponent_name").alias("x"), F.greatest("champion", "opponent_name").alias("y")).agg(F.min_by(F.struct("win_rate", "games"), "src").alias("s"))
    pr = M.lineup_pairs(I.games(spark, sf), ["gameid"], [f"blue_{x}_champion" for x in rs.ROLES])
    j = pr.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(one, ["x", "y"]).filter("s.win_rate > 0.45 AND s.games >= 3")
    return j.groupBy("gameid").agg(F.count("*").alias("pairs"), r(F.sum("s.win_rate") + 1e-9, 5).alias("wr_sum"))


@query(
    "lane_power",
    with_inputs(
        "SELECT gameid, side, CAST(sum(coalesce(t.engage, 1) + coalesce(t.burst, 1) + coalesce(t.linestrength, 0)) AS BIGINT) AS power FROM player_rows p LEFT JOIN tags t USING (champion) GROUP BY 1, 2", "player_rows", "tags"
    ),
)
def lane_power(spark, sf):
    p = I.player_rows(spark, sf).select("gameid", "side", "champion")
    return M.lane_power(p, I.tags(spark, sf), ["engage", "burst", "linestrength"], ["gameid", "side"], D.TAG_DEFAULTS)


@query(
    "explain_features",
    "SELECT p_partkey, p_name AS feature, (SELECT arg_max('about ' || d.name, length(d.name)) FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 5 = 0) d WHERE starts_with(p.p_name, d.name)) AS text FROM part p",
)
def explain_features(spark, sf):
    p = I.table(spark, sf, "part")
    d = p.select(F.split("p_name", " ")[0].alias("name")).union(p.filter("p_partkey % 5 = 0").select("p_name")).distinct()
    d = d.withColumn("text", F.concat(F.lit("about "), F.col("name")))
    return M.explain(p.select("p_partkey", F.col("p_name").alias("feature")), d).select("p_partkey", "feature", "text")


def linear_model(weights, bias):
    """Smallest possible stand-in for a user's model: any object with predict(matrix) works."""

    class Linear:
        def predict(self, x):
            import numpy as np

            return 1 / (1 + np.exp(-(x @ np.asarray(weights, dtype="float32") + bias)))

    return Linear()


@query(
    "score_model",
    "SELECT l_suppkey, count(*) AS n, round(avg((1 / (1 + exp(-(l_quantity * 0.02 - l_discount * 3 - 0.2))) + 1 / (1 + exp(-(l_quantity * 0.01 + l_discount * 2 - 0.4)))) / 2), 4) AS p FROM lineitem GROUP BY 1",
)
def score_model(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    out = M.score(li, [linear_model([0.02, -3.0], -0.2), linear_model([0.01, 2.0], -0.4)], ["l_quantity", "l_discount"])
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.avg("p"), 4).alias("p"))


@query("bagged_model")
def bagged_model(spark, sf):
    o = I.table(spark, sf, "lineitem").selectExpr("l_suppkey", "l_quantity", "l_discount", "CAST(l_returnflag = 'N' AS DOUBLE) AS y", "1.0D + l_tax AS w")
    models = M.fit_bagged(o, ["l_quantity", "l_discount"], "y", "w", seeds=[1, 2], kind="logistic", maxIter=5)
    return M.predict_bagged(o, models, ["l_quantity", "l_discount"]).groupBy("l_suppkey").agg(F.avg("p").alias("p"))
