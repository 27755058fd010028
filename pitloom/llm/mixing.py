"""Mixing sources to target weights by temperature, with DataFrame operations only.

The weight of a source is its token share to the power of an exponent, normalised. The exponent lies in [0, 1] (1
keeps the shares, 0 makes them equal) and is bisected to meet a target entropy or a repetition limit: a Spark
aggregate evaluates the inner points of five halvings at once over the table of sources, so the driver sees a row for each
point and never the sources.

A source's budget is realised by whole passes and one partial pass. Documents fall into blocks by hash, the blocks of
a source are put in hash order, and the partial pass takes blocks from the front; inside the block that the budget
cuts, documents are taken in hash order. A hot source has many blocks, so no task holds more than one block's
documents or one row for each block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitloom.llm.common import fresh, row_key, squeeze, stored

#: Documents of a source in a block, on average.
BLOCK_DOCS = 512
#: Rounds of five halvings: the exponent is found to 2 ** -30.
ROUNDS, HALVINGS = 6, 5


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    x = F.trim(squeeze(text))
    return F.when(x == "", F.lit(0)).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("long")


def place_of(key: Column) -> Column:
    """A number below 2 ** 60 from the MD5 of a string."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _points(shares: DataFrame, grid: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, largest weight over share) for each exponent."""
    power = F.pow(F.col("share"), F.col("exponent"))
    spread = shares.filter("tokens > 0").select("share", F.explode(F.lit(grid)).alias("exponent"))
    sums = spread.groupBy("exponent").agg(F.sum(power).alias("z"), F.sum(power * F.col("exponent") * F.ln("share")).alias("e"), F.max(power / F.col("share")).alias("m"))
    return [(r["exponent"], math.log(r["z"]) - r["e"] / r["z"], r["m"] / r["z"]) for r in sums.orderBy("exponent").collect()]


def find_exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float) -> float:
    """The largest exponent whose entropy is at least `target_entropy` (a part of the largest, ln of the number of
    sources), or the smallest under which no source is repeated more than `max_repeats` times; given both, the limit
    on repeats comes first."""
    n = shares.filter("tokens > 0").count()
    if n < 2:
        return 1.0
    sides = []
    if target_entropy is not None:
        wanted = target_entropy * math.log(n) - 1e-12
        sides.append((lambda p: p[1] >= wanted, True))
    if max_repeats is not None:
        sides.append((lambda p: p[2] * budget_share <= max_repeats + 1e-12, False))
    found = []
    for holds, at_low in sides:
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            step = (high - low) / 2**HALVINGS
            points = _points(shares, [low + step * i for i in range(2**HALVINGS + 1)])
            if at_low:  # holds for small exponents, up to the one that is sought
                last = max((p[0] for p in points if holds(p)), default=low)
                low, high = last, min(last + step, high)
            else:  # holds for large exponents, from the one that is sought
                first = min((p[0] for p in points if holds(p)), default=high)
                low, high = max(first - step, low), first
            if low == high:
                break
        found.append(low if at_low else high)
    return max(found, default=1.0)


def mix(
    docs: DataFrame,
    target_entropy: float | None = 0.95,
    max_repeats: float | None = 2.0,
    budget_share: float = 1.0,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "mix",
) -> DataFrame:
    """One row for each row of `docs`: doc_id, row_key, source, n_tokens, exponent, weight, copies, block, block_place.

    The budget is `budget_share` times all tokens. `copies` says how often a row stands in the mixture (0: dropped),
    `block_place` the place of its block in the source's permutation. A null source is the source "", a null text has
    no tokens; rows without tokens are taken with the whole passes and with the blocks that fit. Rows with equal ids
    are placed alike, by id, then tokens. A single source keeps weight 1. An empty table gives no rows; other columns
    are not read.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        row_key(F.col(doc_id), F.col(text)).alias("row_key"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        word_count(F.col(text)).alias("n_tokens"),
        place_of(F.concat(F.lit(seed + ":"), key)).alias("place"),
    )
    rows = stored(rows, "mix-rows")
    shares = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    shares = stored(shares.withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS)), "mix-sources")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    rows = rows.join(shares.select("source", "n_blocks"), "source").withColumn("block", F.pmod("place", "n_blocks")).drop("n_blocks")
    blocks = stored(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    shares = shares.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = find_exponent(shares, target_entropy, max_repeats, budget_share)
    power = F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    norm = shares.agg(F.sum(power)).first()[0] or 1.0
    # a budget that is a whole number but for the order of additions is that number
    budget = F.floor(power / F.lit(norm) * F.lit(budget_share * total) + F.lit(1e-6))
    plan = shares.select("source", "tokens", (power / F.lit(norm)).alias("weight"), budget.alias("budget"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)))
    plan = plan.select("source", "weight", "passes", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0).alias("rest"))
    order = W.partitionBy("source").orderBy(F.md5(F.concat(F.lit(seed + ":"), "source", F.lit(":"), F.col("block").cast("string"))), "block")
    placed = blocks.select("source", "block", "tokens", F.row_number().over(order).alias("block_place"), F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    placed = placed.join(plan, "source").select("source", "block", "block_place", "weight", "passes", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"), "tokens")
    placed = stored(placed.withColumnRenamed("tokens", "block_tokens"), "mix-placed")
    found = rows.join(placed, ["source", "block"])
    inside = W.partitionBy("source", "block").orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    whole, cut = F.col("block_tokens") <= F.col("left"), (F.col("left") > 0) & (F.col("block_tokens") > F.col("left"))
    out = ["doc_id", "row_key", "source", "n_tokens", F.lit(exponent).alias("exponent"), F.round("weight", 9).alias("weight"), F.col("copies").cast("long"), "block", F.col("block_place").cast("long")]
    plain = found.filter(~cut).withColumn("copies", F.col("passes") + F.when(whole, 1).otherwise(0)).select(*out)
    parted = found.filter(cut).withColumn("upto", F.sum("n_tokens").over(inside))
    parted = parted.withColumn("copies", F.col("passes") + F.when(F.col("upto") <= F.col("left"), 1).otherwise(0)).select(*out)
    return plain.unionByName(parted)


def realise(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` as often as `mixed` says, with the columns of `docs`; rows told twice are each taken so often."""
    own, other, n = fresh(docs, "row_key"), fresh(docs, "mixed_row_key"), fresh(docs, "copies")
    copies = mixed.filter("copies > 0").groupBy(F.col("row_key").alias(other)).agg(F.max("copies").alias(n))
    found = docs.withColumn(own, row_key(F.col(doc_id), F.col(text)))
    found = found.join(copies, F.col(own) == F.col(other))
    each = fresh(docs, "copy")
    return found.withColumn(each, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
