"""Ranking, fusion and filters over (query, candidate) rows.

Groups are the candidates of one query, at most one vocabulary. Where the
mapped data has bigger groups, `cells` ranks inside score cells and adds the
counts of the better cells, so no task needs a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitloom.functions.columns import col, lineup_feasible, role_mask, tanh_percentile
from pitloom.operators.candidates import HARD, POSITIONS
from pitloom.operators.history import prior_scan


def _order(score, tie):
    return [col(score).desc(), *[col(t).asc() for t in ([tie] if isinstance(tie, str) else tie)]]


def topk(df: DataFrame, q, score: str, k: int = 50, tie="candidate_id", mask: str | None = None, rank="rank") -> DataFrame:
    """k best available candidates per query; each task cuts to k before the shuffle."""
    rows = df if mask is None else df.filter(F.col(mask) == 1)
    w = W.partitionBy(*([q] if isinstance(q, str) else q)).orderBy(*_order(score, tie))
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rank_map(df: DataFrame, q: str, score: str, tie="candidate_id", rank="rank", total="total_valid", cells: int = 0) -> DataFrame:
    """Rank of every candidate, size of its group and rank percentile 1 - rank / size."""
    size = df.groupBy(q).agg(
        F.count("*").cast("long").alias(total), F.min(score).alias("_lo"), F.max(score).alias("_hi")
    )
    rows = df.join(size, q)
    if cells:
        width = F.col("_hi") - F.col("_lo")
        cell = F.when(width > 0, F.floor((F.col("_hi") - F.col(score)) / width * cells)).otherwise(F.lit(0).cast("long"))
        rows = prior_scan(rows, [q], cell, _order(score, tie), {"_n": ("count", F.lit(1))})
        rows = rows.withColumn(rank, F.col("_n") + 1).drop("_n")
    else:
        rows = rows.withColumn(rank, F.row_number().over(W.partitionBy(q).orderBy(*_order(score, tie))))
    return rows.drop("_lo", "_hi").withColumn(f"{rank}_pct", 1 - F.col(rank) / F.greatest(F.col(total), F.lit(1)))


def score_stats(df: DataFrame, q: str, score: str, mask: str = "mask") -> DataFrame:
    """Per query: min, max, range, mean, deviation (at least 1e-6), normal quartiles, top score."""
    ok = F.when(F.col(mask) == 1, F.col(score))
    s = df.groupBy(q).agg(
        F.coalesce(F.min(ok), F.lit(0.0)).alias("logit_min"),
        F.coalesce(F.max(ok), F.lit(1.0)).alias("logit_max"),
        F.coalesce(F.max(ok) - F.min(ok), F.lit(1e-6)).alias("logit_range"),
        F.coalesce(F.avg(ok), F.lit(0.0)).alias("valid_mean"),
        F.when(F.count(ok) > 0, F.greatest(F.stddev_pop(ok), F.lit(1e-6))).otherwise(1.0).alias("valid_std"),
        F.max(score).alias("top1_logit"),
    )
    m, d = F.col("valid_mean"), F.col("valid_std")
    return s.withColumns(
        {"valid_median": m, "valid_q75": m + 0.675 * d, "valid_q25": m - 0.675 * d, "valid_iqr": 1.35 * d}
    )


def pick_features(df: DataFrame, phase_split: int = 12) -> DataFrame:
    """24 cascade columns for picks.

    df: cs_logit, nocs_logit, cs_rank_pct, nocs_rank_pct, bp_step and the candidate columns.
    """
    p1 = F.when(F.col("bp_step") < phase_split, 1.0).otherwise(0.0)
    p2 = 1 - p1
    c = F.col
    has_ally = F.when(c("n_ally_picked") >= 1, 1.0).otherwise(0.0)
    return df.withColumns(
        {
            "logit_diff": c("cs_logit") - c("nocs_logit"),
            "synergy_ally": c("ally_synergy"),
            "counter_enemy": c("enemy_counter"),
            "role_fit_ally": c("ally_role_fit"),
            "p1_meta_presence": c("meta_presence") * p1,
            "p1_mastery": c("player_mastery") * p1,
            "p1_cs_logit": c("cs_logit") * p1,
            "p2_role_fit": c("ally_role_fit") * p2,
            "p2_synergy": c("ally_synergy") * p2,
            "p2_counter": c("enemy_counter") * p2,
            "p2_mastery_x_role": c("player_mastery") * c("ally_role_fit") * p2,
            "perfect_fit": c("ally_role_fit") * c("ally_synergy"),
            "counter_kill": c("ally_role_fit") * c("enemy_counter"),
            "combo_synergy": c("last_ally_synergy") * has_ally,
            "enemy_mastery_choke": c("enemy_mastery_max") * c("enemy_counter"),
        }
    )


def ban_features(df: DataFrame, phase_bans: int = 3, score: str = "transformer_logit") -> DataFrame:
    """19 cascade columns for bans; df carries valid_mean, valid_std, top1_logit of its query."""
    c = F.col
    p1 = F.when(c("ban_step") <= phase_bans, 1.0).otherwise(0.0)
    p2 = 1 - p1
    choke_meta = c("enemy_role_fit") * c("meta_wr")
    choke_mastery = c("enemy_role_fit") * c("enemy_mastery_max")
    return df.withColumns(
        {
            "logit_percentile": tanh_percentile(score, "valid_mean", "valid_std"),
            "logit_gap_top1": c(score) - c("top1_logit"),
            "meta_ban_rate": c("meta_ban"),
            "p1_meta_ban": c("meta_ban") * p1,
            "p1_threat_respect": c("respect") * c("enemy_mastery_max") * p1,
            "p1_threat_hot_streak": c("hot_streak") * c("enemy_mastery_max") * p1,
            "p2_choke_meta": choke_meta * p2,
            "p2_choke_mastery": choke_mastery * p2,
            "p2_grudge": c("grudge") * p2,
            "p2_enemy_mastery": c("enemy_mastery_max") * p2,
            "threat_meta_mastery": c("meta_ban") * c("enemy_mastery_max"),
            "choke_composite": (choke_meta + choke_mastery) * p2,
        }
    )


def rank_normalise(df: DataFrame, q: str, score: str, tie="candidate_id", out="rn", cells: int = 0) -> DataFrame:
    """Evenly spaced 1 .. 0 by rank inside each query (a single candidate gets 1)."""
    r = rank_map(df, q, score, tie, "_rk", "_sz", cells)
    n = F.greatest(F.col("_sz") - 1, F.lit(1))
    return r.withColumn(out, 1 - (F.col("_rk") - 1) / n).drop("_rk", "_sz", "_rk_pct")


def blend(a, b, alpha: float, mode: str = "blend") -> Column:
    return col(a) * alpha + col(b) * (1 - alpha) if mode == "blend" else col(a) + col(b)


def tune_alpha(df: DataFrame, q: str, a: str, b: str, label: str, grid: list[float], k: int = 10, tie="candidate_id") -> DataFrame:
    """hit@k per alpha in one grouped pass; the first best alpha is flagged.

    A positive is hit when fewer than k candidates beat it, so every alpha is
    one conditional count and nothing is sorted or multiplied per alpha.
    """
    pos = df.filter(F.col(label) == 1).groupBy(q).agg(
        F.min_by(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(tie).alias("t")), tie).alias("_p")
    )
    rows = df.join(pos, q)

    def beats(al):
        # nine digits: equal blends must stay equal however they were added up
        mine = F.round(F.col(a) * al + F.col(b) * (1 - al), 9)
        ref = F.round(F.col("_p.a") * al + F.col("_p.b") * (1 - al), 9)
        return (mine > ref) | ((mine == ref) & (F.col(tie) < F.col("_p.t")))

    per_q = rows.groupBy(q).agg(*[F.count_if(beats(al)).alias(f"_{i}") for i, al in enumerate(grid)])
    hits = per_q.agg(*[F.avg((F.col(f"_{i}") < k).cast("int")).alias(f"_{i}") for i in range(len(grid))])
    long = hits.select(
        F.inline(F.array(*[F.struct(F.lit(float(al)).alias("alpha"), F.col(f"_{i}").alias("hit_rate")) for i, al in enumerate(grid)]))
    )
    best = long.agg(F.max_by("alpha", F.struct("hit_rate", -F.col("alpha"))).alias("x")).scalar()
    return long.withColumn("best", (F.col("alpha") == best))


def ensemble_mean(df: DataFrame, row: list[str], pred: str) -> DataFrame:
    return df.groupBy(*row).agg(F.avg(pred).alias(pred), F.count("*").alias("n_models"))


def with_priors(df: DataFrame, priors: DataFrame, min_prob: float = 0.15, out: str = "_p") -> DataFrame:
    """Attach the position table as one map: id -> best probability, its position (0-4), role mask, all five.

    The map has one entry per vocabulary item and is built once for the query.
    """
    best = F.array_max("pos")
    facts = priors.select(
        "candidate_id",
        F.struct(
            best.alias("best"),
            (F.array_position("pos", best) - 1).cast("int").alias("at"),
            role_mask(F.col("pos"), min_prob).alias("roles"),
            F.col("pos"),
        ).alias("v"),
    )
    return df.withColumn(out, facts.agg(F.map_from_entries(F.collect_list(F.struct("candidate_id", "v")))).scalar())


def _fact(item, field):
    return F.try_element_at(F.col("_p"), item)[field]


def _hard_bits(champions, hard: float = HARD) -> Column:
    """Bit per position that some champion holds for certain."""
    def bit(acc, c):
        held = F.call_function("shiftleft", F.lit(1), _fact(c, "at"))
        return acc.bitwiseOR(F.when(_fact(c, "best") >= hard, held).otherwise(F.lit(0)))

    return F.aggregate(col(champions), F.lit(0), bit)


def _has_bit(bits: Column, at: Column) -> Column:
    return F.call_function("shiftright", bits, at).bitwiseAND(F.lit(1)) == 1


#: Subsets of the five roles, as bit masks.
_ROLE_SETS = range(1, 32)


def _bits_of(test) -> Column:
    """Long with a bit for each subset of roles (a column) that passes `test`."""
    sets = F.array(*[F.lit(x) for x in _ROLE_SETS])
    return F.aggregate(sets, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.when(test(x), F.call_function("shiftleft", F.lit(1).cast("long"), x)).otherwise(F.lit(0).cast("long"))))


def _within(roles: Column, subset: Column) -> Column:
    return roles.bitwiseAND(F.lit(31) - subset) == 0


def _candidates(df: DataFrame, priors: DataFrame, made: dict[str, Column], candidates: DataFrame | None, min_prob: float = 0.15) -> DataFrame:
    """`df` with the columns `made` and a candidate's facts as `_c`: best, at, pos, in_sets (the sets of roles that hold all of its own).

    With `candidates` (candidate_id) a row of `df` is a query. What is `made` of it comes before it is unfolded, so once for all
    of its candidates, and these bring their facts along instead of looking them up.
    """
    known = with_priors(df, priors, min_prob).withColumns(made)
    sets = lambda f: _bits_of(lambda x: _within(F.coalesce(f["roles"], F.lit(31)), x))
    facts = lambda f: F.struct(f["best"].alias("best"), f["at"].alias("at"), f["pos"].alias("pos"), sets(f).alias("in_sets"))
    if candidates is None:
        return known.withColumn("_c", facts(F.try_element_at("_p", F.col("candidate_id")))).drop("_p")
    listed = with_priors(candidates.select("candidate_id").distinct(), priors, min_prob)
    listed = listed.select("candidate_id", facts(F.try_element_at("_p", F.col("candidate_id"))).alias("_c"))
    return known.drop("_p").select("*", F.inline(listed.agg(F.collect_list(F.struct("candidate_id", "_c"))).scalar()))


def _columns(df: DataFrame, candidates: DataFrame | None) -> list[str]:
    return [*df.columns] if candidates is None else [*df.columns, "candidate_id"]


def filter_pick_conflicts(df: DataFrame, priors: DataFrame, ally: str = "ally", min_prob=0.15, crowd=2.0, main=0.4, candidates: DataFrame | None = None) -> DataFrame:
    """Drop candidates that cannot join the lineup: a hard position that is taken, a main
    position held twice, an overcrowded position, or no assignment of five roles.

    df: candidate_id and `ally`, or `ally` alone with all `candidates` for each row. No assignment is left if more champions live
    inside a set of roles than the set has (Hall): the sets that are full already are bits of one long per lineup.
    """
    mates = F.col(ally)
    count_at = lambda i: F.size(F.filter(mates, lambda c: F.coalesce(_fact(c, "at"), F.lit(0)) == i))
    held_at = lambda i: F.aggregate(mates, F.lit(0.0), lambda acc, c: acc + F.coalesce(_fact(c, "pos")[i], F.lit(0.0)))
    same, held = [count_at(i) for i in range(5)], [held_at(i) for i in range(5)]
    roles = F.transform(mates, lambda c: F.coalesce(_fact(c, "roles"), F.lit(31)))
    living = lambda x: F.size(F.filter("_roles", lambda m: _within(m, x)))
    made = {"_hard": _hard_bits(ally), "_same": F.array(*same), "_held": F.array(*held), "_roles": roles}
    full = F.when(lineup_feasible("_roles"), _bits_of(lambda x: living(x) >= F.bit_count(x))).otherwise(F.lit(-1).cast("long"))
    q = with_priors(df, priors, min_prob).withColumns(made).withColumn("_full", full).drop("_p", "_roles")
    d = _candidates(q, priors, {}, candidates, min_prob)
    best, at = F.coalesce(F.col("_c.best"), F.lit(0.0)), F.coalesce(F.col("_c.at"), F.lit(0))
    clash = (best >= HARD) & _has_bit(F.col("_hard"), at)
    crowded = (F.get("_same", at) >= 2) | ((best >= main) & (F.get("_held", at) + best > crowd))
    stuck = F.col("_full").bitwiseAND(F.col("_c.in_sets")) != 0
    bad = clash | ((F.size(mates) > 0) & (crowded | stuck))
    return d.filter(~bad).select(*_columns(df, candidates))


def filter_ban_conflicts(df: DataFrame, priors: DataFrame, enemy: str = "enemy", candidates: DataFrame | None = None) -> DataFrame:
    """Drop hard candidates for a position the enemy has already filled for certain (`candidates`: see `filter_pick_conflicts`)."""
    d = _candidates(df, priors, {"_hard": _hard_bits(enemy)}, candidates)
    bad = (F.col("_c.best") >= HARD) & _has_bit(F.col("_hard"), F.col("_c.at"))
    return d.filter(~F.coalesce(bad, F.lit(False))).select(*_columns(df, candidates))


def enrich(df: DataFrame, priors: DataFrame, action: str = "pick", ally: str = "ally", candidates: DataFrame | None = None, facts: dict[str, Column] | None = None) -> DataFrame:
    """Best position, free second position, conflict flag and reason tags.

    df: candidate_id, ally, meta_wr, meta_presence, meta_ban; or a row per query with all `candidates` (see
    `filter_pick_conflicts`) and the missing columns as `facts`.
    """
    d = _candidates(df, priors, {"_hard": _hard_bits(ally)}, candidates).withColumns(facts or {})
    kept = [*_columns(df, candidates), *(facts or {})]
    d = d.withColumns(
        {
            "_pos": F.coalesce(F.col("_c.pos"), F.array(*[F.lit(0.2)] * 5)),
            "_best": F.coalesce(F.col("_c.best"), F.lit(0.2)),
            "_at": F.coalesce(F.col("_c.at"), F.lit(0)),
        }
    )
    taken = _has_bit(F.col("_hard"), F.col("_at"))
    free = [F.when((F.get("_pos", F.lit(i)) > 0.15) & ~_has_bit(F.col("_hard"), F.lit(i)), F.get("_pos", F.lit(i))) for i in range(5)]
    d = d.withColumn("_alt", F.greatest(*free))
    prob = F.when(taken & F.col("_alt").isNotNull(), F.col("_alt")).otherwise(F.col("_best"))
    d = d.withColumns({"position_conflict": taken & F.col("_alt").isNull(), "assigned_prob": prob})
    wr, pres, ban = F.col("meta_wr"), F.col("meta_presence"), F.col("meta_ban")
    strength = [F.when(wr > 0.55, "strong_patch").when(wr > 0.4, "good_win_rate")]
    rates = [F.when(pres >= 0.2, "high_presence"), F.when(ban > 0.2, "high_ban_rate")]
    fit = [F.when(F.col("assigned_prob") >= HARD, "position_fit").when(F.col("position_conflict"), "flex")]
    tags = [*fit, *strength, *rates] if action == "pick" else [rates[1], rates[0], *strength]
    name = F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), F.col("_at") + 1)
    return d.select(
        *kept,
        name.alias("best_position"),
        F.col("_best").alias("best_position_prob"),
        "assigned_prob",
        "position_conflict",
        F.filter(F.array(*tags), lambda t: t.isNotNull()).alias("reasons"),
    )


def catalogue(vocab: DataFrame, stats: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Vocabulary with statistics and tags, most present first."""
    out = vocab.join(stats, "champion", "left")
    if tags is not None:
        out = out.join(tags, "champion", "left")
    return out.withColumn("presence", F.coalesce("presence", F.lit(0.0))).orderBy(F.col("presence").desc(), "champion")


def renumber(df: DataFrame, q: str, score: str, n: int, tie="candidate_id") -> DataFrame:
    return topk(df, q, score, n, tie)
