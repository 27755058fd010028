"""Substring dedup by seed and extend.

A window is `length` consecutive words. Seeds are winnowed: of the word k-grams in a window the one with the smallest
hash is its anchor, so equal windows of any two documents have the same anchor and every match of at least `length`
words holds one. Neighbouring windows of one anchor form a run, the anchor extended both ways as far as it leads.

1. Documents meet on their anchors; anchors that only one document has go.
2. Runs of one anchor with equal content are one class (copies, and the inside of a shared passage). If an anchor has
   one class, the class's smallest document owns all its windows.
3. If an anchor leads to several classes, one run of each class is extended word by word: its windows, which hold every
   extension to the left and right, are keyed by content and take the smallest document of all classes.
4. A document loses the windows that a smaller document owns; touching windows merge to maximal repeats.

No pairs are made: every exchange holds a row for an anchor, a run or a window at most. Anchor and window are told
apart by 64 bits each of independent hashes, 128 for a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import row_key, stored
from pitloom.llm.words import mix, seeded, word_hashes, words_of

LENGTH, GRAM = 50, 10
#: Windows in a run at most; longer runs (one word again and again) are cut.
RUN = 64
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        m = max(n, 1 << 15)
        up, down = np.full(m, base, dtype=np.uint64), np.full(m, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return held[0][:n], held[1][:n]


def rolling(x: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of every `size` consecutive numbers."""
    up, down = _powers(base, len(x) + 1)
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(x) - size + 1])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    step, low = 1, x
    while step * 2 <= size:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return low if step == size else np.minimum(low[: len(x) - size + 1], low[size - step :])


def windows(hashes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, content hash) of each window."""
    anchor = sliding_min(rolling(hashes, gram, _BASE), length - gram + 1)
    return anchor, rolling(seeded(hashes, 11), length, _BASE2)


def runs(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, content hash) of each run of windows with one anchor."""
    n = len(anchor)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    start = np.concatenate(([0], change))
    size = np.diff(np.append(start, n))
    if (size > RUN).any():
        parts = -(-size // RUN)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + place * RUN
        size = np.diff(np.append(start, n))
    offset = np.arange(n) - np.repeat(start, size)
    total = np.add.reduceat(mix(content + mix(offset.astype(np.uint64))), start)
    return start, size, mix(total + size.astype(np.uint64))


def _seeds(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for i, key, text in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(text)
            if len(words) < length:
                continue
            anchor, content = windows(word_hashes(words), length)
            start, size, ctx = runs(anchor, content)
            out.append((np.full(len(start), i), [key] * len(start), anchor[start].view(np.int64), ctx.view(np.int64), start, size))
        if out:
            join = lambda k, t: pa.array(np.concatenate([o[k] for o in out]).astype(t))
            keys = pa.array([x for o in out for x in o[1]], pa.string())
            yield pa.RecordBatch.from_arrays(
                [join(0, np.int64), keys, join(2, np.int64), join(3, np.int64), join(4, np.int32), join(5, np.int32)],
                names=["doc_id", "row_key", "anchor", "context", "start", "size"],
            )


def _extend(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for i, text, wanted in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
            words = words_of(text)
            if len(words) < length:
                continue
            anchor, content = windows(word_hashes(words), length)
            start, size, ctx = runs(anchor, content)
            left = {(w["anchor"], w["context"]) for w in wanted}
            for s, n, a, c in zip(start.tolist(), size.tolist(), anchor[start].view(np.int64).tolist(), ctx.view(np.int64).tolist(), strict=True):
                if (a, c) in left:
                    left.discard((a, c))
                    out[0] += [i] * n
                    out[1] += [a] * n
                    out[2] += [c] * n
                    out[3] += range(n)
                    out[4] += content[s : s + n].view(np.int64).tolist()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "anchor", "context", "place", "content"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, hashes = [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words = words_of(text)
            n_words.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, [s["begin"] for s in spans], 1)
                np.add.at(edge, [s["end"] for s in spans], -1)
                keep = np.cumsum(edge[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            n_removed.append(n_words[-1] - len(words))
            hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
        )


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).cast("string").alias("text"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """row_key, doc_id, spans: for each row with a repeat, the word ranges (begin, end exclusive) of runs of windows that also
    start in a document with a smaller id. Ranges of a row may overlap; their union is its maximal repeats."""
    base = _base(docs, doc_id, text)
    seeds = base.filter("doc_id is not null").mapInArrow(partial(_seeds, length=length), "doc_id long, row_key string, anchor long, context long, start int, size int")
    seeds = stored(seeds, "seeds")
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")
    met = stored(seeds.join(shared, "anchor"), "met")
    classes = stored(met.groupBy("anchor", "context").agg(F.min("doc_id").alias("owner")), "classes")
    forks = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    wanted = classes.join(forks, "anchor").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "context")).alias("wanted"))
    extended = base.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        partial(_extend, length=length), "doc_id long, anchor long, context long, place int, content long"
    )
    extended = stored(extended, "extended")
    best = extended.groupBy("anchor", "content").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    taken = extended.join(best.select("anchor", "content", "low"), ["anchor", "content"]).filter("low < doc_id")
    exact = taken.groupBy("anchor", "context").agg(F.collect_list(F.struct("place", "low")).alias("exact"))
    classes = classes.join(exact, ["anchor", "context"], "left")
    found = met.join(classes, ["anchor", "context"])
    window = lambda at, n: F.struct((F.col("start") + at).alias("begin"), (F.col("start") + at + n + (length - 1)).alias("end"))
    some = F.filter(F.col("exact"), lambda x: x["low"] < F.col("doc_id"))
    spans = F.when(F.col("owner") < F.col("doc_id"), F.array(window(F.lit(0), F.col("size")))).otherwise(F.transform(some, lambda x: window(x["place"], F.lit(1))))
    found = found.select("doc_id", "row_key", spans.alias("spans")).filter("size(spans) > 0")
    return found.groupBy("doc_id", "row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    A null text has no words. Rows of one id are one document: they take nothing from each other. A row without an id
    neither loses words nor owns any. Texts shorter than a window stay whole. An empty table gives no rows; other
    columns are neither read nor returned.
    """
    spans = repeats(docs, doc_id, text, length).select("row_key", "spans")
    joined = _base(docs, doc_id, text).join(spans, "row_key", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
