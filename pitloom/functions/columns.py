"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(col(ts).cast("timestamp"))


def day_number(ts) -> Column:
    """Calendar day as days since the epoch."""
    return F.unix_date(F.to_date(col(ts)))


def parse_percent(c) -> Column:
    """'53.2%' -> 0.532; values above 1 are read as percent; unreadable text -> null."""
    x = F.regexp_replace(F.trim(col(c).cast("string")), "%$", "").try_cast("double")
    return F.when(x > 1, x / 100).otherwise(x)


def patch_index(c) -> Column:
    """'major.minor' -> major * 24 + minor, anything malformed -> 0."""
    parts = F.split(col(c).cast("string"), r"\.")
    major, minor = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.coalesce(major * 24 + minor, F.lit(0))


def bayes_rate(wins, games, m=2.0, prior=0.5) -> Column:
    return (col(wins) + m * prior) / (col(games) + m)


def laplace_rate(wins, picks) -> Column:
    return (col(wins) + 1) / (col(picks) + 2)


def wins_from_rate(rate, games) -> Column:
    """Whole wins from a rate, halves to the even neighbour."""
    return F.bround(col(rate) * col(games), 0)


def safe_div(a, b, default=None) -> Column:
    """a / b, with `default` (column, number or null) where b is 0."""
    d = F.lit(default) if not isinstance(default, Column) else default
    return F.when(col(b) != 0, F.try_divide(col(a), col(b))).otherwise(d)


def clip(c, lo, hi) -> Column:
    """Clamp that keeps nulls null."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi)))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def logit(p, eps=1e-12) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def log_saturation(g, full) -> Column:
    return F.least(F.log1p(col(g)) / F.log1p(F.lit(float(full))), F.lit(1.0))


def tanh_percentile(x, mean, std) -> Column:
    z = (col(x) - col(mean)) / F.greatest(col(std), F.lit(1e-6)) * 0.5
    return 0.5 * (1 + F.tanh(z))


def finite(c) -> Column:
    """NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def finite_or(c, value=0.0) -> Column:
    return F.coalesce(finite(c), F.lit(value))


def months_before(ts, months) -> Column:
    return F.add_months(col(ts), -months)


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def spread(cols) -> Column:
    """Sample standard deviation over a few columns of one row (0 for a single one)."""
    n = len(cols)
    if n <= 1:
        return F.lit(0.0)
    mean = total(cols) / n
    return F.sqrt(total([(c - mean) * (c - mean) for c in cols]) / (n - 1))


def pipe_list(c) -> Column:
    """'a| b|' -> ['a', 'b']; null -> empty array."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def role_mask(prior, min_prob=0.15) -> Column:
    """Bit mask of the roles a prior array allows; all five when none reaches `min_prob`."""
    bits = [F.when(F.get(prior, F.lit(i)) >= min_prob, 1 << i).otherwise(0) for i in range(5)]
    mask = total(bits)
    return F.when(prior.isNull() | (mask == 0), 31).otherwise(mask)


def _place(state: Column, mask: Column) -> Column:
    """Occupied-role sets reachable after one more entry took one of its free roles."""
    out = None
    for role in range(5):
        free = sum(1 << s for s in range(32) if not s >> role & 1)  # sets without this role
        moved = F.shiftleft(state.bitwiseAND(F.lit(free)), 1 << role)
        term = F.when(mask.bitwiseAND(F.lit(1 << role)) != 0, moved).otherwise(F.lit(0).cast("long"))
        out = term if out is None else out.bitwiseOR(term)
    return out


def lineup_feasible(masks) -> Column:
    """Can every entry of an array of role masks get a role of its own?

    The sets of occupied roles that are reachable so far are the bits of one
    long (32 sets of five roles); each entry moves them on. No set left = no
    assignment.
    """
    return F.aggregate(col(masks), F.lit(1).cast("long"), lambda st, m: _place(st, m)) != 0


def decay_weight(days, half_life) -> Column:
    import math

    return F.exp(-math.log(2) / half_life * col(days))
