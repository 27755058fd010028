"""Exact top-k inner product search by a bit-sliced index.

Components are quantised to integers. A block of rows keeps, for each dimension, one bitmap for each bit of the component above the
block's minimum. For a query the bitmaps are added by weight with carry-save adders (bitmap XOR, AND and OR; a
negative query component adds the complements), which gives the slices of all scores of the block at once. The top
rows are selected from the most significant slice downward; the rows that still tie at the border are resolved
exactly by id. The index is a table; query batches meet its blocks by an equi join, and each block answers with k rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitloom.llm.common import stored

#: Rows of a block at most (on average), and blocks at least.
BLOCK_ROWS, LEAST_BLOCKS = 65536, 16
#: Queries that one task takes at a time.
QUERY_GROUP = 8192
#: Bitmap words that adders work on at once.
WORDS = 2048


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component in double precision; null where the vector is null or holds null, NaN or an infinity."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _index_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row: sorted ids, minimum and number of slices of each dimension, the packed slices."""
    rows = rows.sort_values("vec_id", kind="stable")
    values = np.array(rows["q"].tolist(), dtype=np.int64).reshape(len(rows), key[0])
    low = values.min(axis=0)
    width = [int(h) - int(m) for h, m in zip(values.max(axis=0), low, strict=True)]
    above = values.view(np.uint64) - low.view(np.uint64)
    words = -(-len(rows) // 64)
    slices = [
        np.pad(np.packbits((above[:, d] >> np.uint64(b)) & np.uint64(1) != 0, bitorder="little"), (0, words * 8 - -(-len(rows) // 8)))
        for d in range(key[0])
        for b in range(width[d].bit_length())
    ]
    return pd.DataFrame(
        {
            "dims": [key[0]],
            "block": [key[1]],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "low": [low.tobytes()],
            "bits": [np.array([w.bit_length() for w in width], dtype=np.int64).tobytes()],
            "slices": [b"".join(s.tobytes() for s in slices)],
        }
    )


def added(stacks: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps: `stacks[w]` holds arrays (queries, bitmaps, words) of weight 2 ** w."""
    out, weight = [], 0
    while weight <= max(stacks, default=-1):
        parts = stacks.pop(weight, [])
        stack = np.concatenate(parts, axis=1) if parts else None
        carries = []
        while stack is not None and stack.shape[1] > 1:
            m = stack.shape[1] // 3 * 3
            if m:
                a, b, c = stack[:, 0:m:3], stack[:, 1:m:3], stack[:, 2:m:3]
                half = a ^ b
                carries.append((a & b) | (c & half))
                stack = np.concatenate((half ^ c, stack[:, m:]), axis=1)
            else:
                carries.append(stack[:, :1] & stack[:, 1:])
                stack = stack[:, :1] ^ stack[:, 1:]
        if carries:
            stacks.setdefault(weight + 1, []).extend(carries)
        out.append(stack[:, 0] if stack is not None else None)
        weight += 1
    return out


def selected(slices: list[np.ndarray], candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows surely among the top k, rows that tie for the places left), from the most significant slice downward."""
    sure, tied = np.zeros_like(candidates), candidates.copy()
    for s in reversed(slices):
        if s is None:
            continue
        more = sure | (tied & s)
        n = np.bitwise_count(more).sum(axis=1)
        many = (n > k)[:, None]
        sure = np.where(many, sure, more)
        tied = np.where(many, tied & s, tied & ~s)
        tied[n == k] = 0
    return sure, tied


def _long(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


def _answer(index: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(place of the query, vec_id, score) of the best k rows of one block."""
    ids = np.frombuffer(index["ids"], dtype=np.int64)
    low, bits = np.frombuffer(index["low"], dtype=np.int64), np.frombuffer(index["bits"], dtype=np.int64)
    n, words, dims = len(ids), -(-len(ids) // 64), len(low)
    plain = np.frombuffer(index["slices"], dtype=np.uint64).reshape(-1, words)
    total = len(plain)
    bank = np.concatenate((plain, ~plain, np.zeros((1, words), dtype=np.uint64)))
    slice_dim = np.repeat(np.arange(dims), bits)
    slice_bit = np.arange(total) - np.repeat(np.cumsum(bits) - bits, bits)
    valid = np.zeros(words * 64, dtype=np.uint8)
    valid[:n] = 1
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    step = max(1, WORDS // max(words, 1))
    for at in range(0, len(queries), step):
        q, own = queries[at : at + step], query_ids[at : at + step]
        size = np.where(q < 0, np.uint64(0) - q.view(np.uint64), q.view(np.uint64))
        depth = int(size.max()).bit_length() if size.size else 0
        stacks: dict[int, list[np.ndarray]] = {}
        for w in range(depth + int(bits.max(initial=0))):
            use = np.flatnonzero((slice_bit <= w) & (w - slice_bit < depth))
            if not len(use):
                continue
            d = slice_dim[use]
            on = (size[:, d] >> (w - slice_bit[use]).astype(np.uint64)) & np.uint64(1) != 0
            which = np.where(on, use + np.where(q[:, d] < 0, total, 0), 2 * total)
            which = np.sort(which, axis=1)[:, : int(on.sum(axis=1).max())]
            if which.shape[1]:
                stacks.setdefault(w, []).append(bank[which])
        sums = added(stacks)
        base = [sum(v * (m if v > 0 else m + (1 << b) - 1) for v, m, b in zip(row, low.tolist(), bits.tolist(), strict=True)) for row in q.tolist()]
        candidates = np.repeat(valid[None, :], len(q), axis=0)
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        for i in np.flatnonzero(last > first):
            for r in range(first[i], last[i]):
                candidates[i, r // 64] &= ~np.uint64(1 << (r % 64))
        sure, tied = selected(sums, candidates, k)
        for i in range(len(q)):
            rows = np.flatnonzero(np.unpackbits(sure[i].view(np.uint8), bitorder="little"))
            if len(rows) < k and tied[i].any():
                rows = np.concatenate((rows, np.flatnonzero(np.unpackbits(tied[i].view(np.uint8), bitorder="little"))[: k - len(rows)]))
            for r in rows.tolist():
                score = sum(((int(s[i, r // 64]) >> (r % 64)) & 1) << w for w, s in enumerate(sums) if s is not None)
                yield at + i, int(ids[r]), _long(score + base[i])


def _search(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    if len(index) and len(queries):
        one = index.iloc[0]
        ids, variant = queries["vec_id"].to_numpy(np.int64), queries["variant"].to_numpy(np.int64)
        values = np.array(queries["q"].tolist(), dtype=np.int64).reshape(len(queries), int(one["dims"]))
        out = [(int(ids[i]), int(variant[i]), v, s) for i, v, s in _answer(one, ids, values, k)]
    return pd.DataFrame(out, columns=["query_id", "variant", "vec_id", "score"])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, query_group: int = QUERY_GROUP
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query row, ties to the smaller id; all, if fewer.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. A vector is
    compared with those of its length; empty vectors score 0. Rows that repeat an id with its vector are one row,
    and rows of the query's id are its own. Components beyond 64 bits and scores beyond them are held at the border.
    An empty table gives no rows; other columns are not read.
    """
    base = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("q"), is_query.alias("asks"))
    base = base.filter("vec_id is not null and q is not null").withColumns({"dims": F.size("q"), "variant": F.xxhash64("q")})
    base = stored(base.dropDuplicates(["vec_id", "variant"]), "vectors")
    n_rows, n_queries = base.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = max(LEAST_BLOCKS, -(-n_rows // block_rows)), max(1, -(-n_queries // query_group))
    dealt = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select("dims", "block", "vec_id", "q")
    index = dealt.groupBy("dims", "block").applyInPandas(_index_block, "dims int, block int, ids binary, low binary, bits binary, slices binary")
    index = stored(index, "bit-slices")
    asked = base.filter("asks").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dims", "block", "part", "vec_id", "variant", "q")
    spread = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key = ["dims", "block", "part"]
    best = spread.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(partial(_search, k=k), "query_id long, variant long, vec_id long, score long")
    order = W.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
