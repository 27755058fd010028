"""Suffix-array dedup: bytes of strings of LENGTH bytes that occur twice or more, by induced sorting.

A window is a string of LENGTH bytes in one document. Its anchor is the k-gram of smallest hash in it, the first of equal ones; equal
windows have equal anchors at equal offsets, so suffixes need to be sorted only with those that share an anchor.

1. Neighbouring windows of one anchor form a run. Anchors that stand in the corpus once go.
2. Runs of equal bytes are one class. Of a class of two or more, all windows are repeated. Of the others, only anchors
   with several classes are left: their bytes, once a class, are dealt to shards by anchor.
3. A shard's suffix array is built by induced sorting: suffixes are classified, leftmost-smaller substrings sorted (names
   that are not unique recursively), and the rest induced bucket by bucket. Its common prefixes are computed in text order
   (permuted): only where the letter before differs are letters compared, elsewhere the value is one less than its left neighbour's.
   A window whose common prefix with a neighbour in the array is LENGTH or more is repeated.
4. An anchor with more than HOT classes (a common line between ever different texts) is split before that: by blocks of offsets to
   the anchor together with the bytes that all windows of a block share, and at last window by window. So no shard holds an unbounded group.

No pairs are made. Rows are told apart by 128 bits of hash of their text (equal texts have equal answers), classes by
128 bits of hash of their bytes; within a shard the bytes themselves are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored
from pitloom.llm.substring_dedup import rolling, sliding_min
from pitloom.llm.words import U, mix

LENGTH, GRAM = 400, 96
#: Windows whose anchors are sought at once, classes of an anchor from which it is split, offsets in a block at each split, bytes in a shard.
CHUNK, HOT, LEVELS, SHARD_BYTES = 1 << 18, 512, (64, 1), 1 << 20
#: Buckets up to which induced sorting goes bucket by bucket; more of them are walked suffix by suffix.
BUCKETS = 512
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0xD1342543DE82EF95
_PLACE = U((1 << 20) - 1)


# ---- suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one behind them; the last letter is smaller than all others."""
    n = len(t)
    smaller = np.ones(n, dtype=bool)
    if n > 1:
        change = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
        change = np.minimum.accumulate(change[::-1])[::-1]
        smaller[:-1] = t[change] < t[change + 1]
    return smaller


def _induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The array that ordered leftmost-smaller suffixes induce: larger suffixes forwards, then smaller ones backwards, a bucket at a time."""
    k = len(starts)
    sa = np.zeros(len(t), dtype=np.int64)
    held = np.bincount(t[seeds], minlength=k)
    by = seeds[np.argsort(t[seeds], kind="stable")]
    sa[np.repeat(ends - np.cumsum(held), held) + np.arange(len(by))] = by

    def put(chunk: np.ndarray, border: np.ndarray, kind: bool) -> None:
        before = chunk[chunk > 0] - 1
        before = before[smaller[before] == kind]
        if not len(before):
            return
        letter = t[before]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        n = np.bincount(letter, minlength=k)
        rank = np.arange(len(before)) - (np.cumsum(n) - n)[letter]
        if kind:
            sa[border[letter] - 1 - rank] = before
            border -= n
        else:
            sa[border[letter] + rank] = before
            border += n

    used = np.flatnonzero(ends > starts).tolist()
    head = starts.copy()
    for c in used:
        i = starts[c]
        while i < head[c]:
            i, chunk = head[c], sa[i : head[c]]
            put(chunk, head, False)
        put(sa[ends[c] - held[c] : ends[c]], head, False)
    tail = ends.copy()
    tail[t[-1]] -= 1
    sa[tail[t[-1]]] = len(t) - 1
    for c in reversed(used):
        i = ends[c]
        while i > tail[c]:
            i, chunk = tail[c], sa[tail[c] : i][::-1]
            put(chunk, tail, True)
        put(sa[starts[c] : head[c]][::-1], tail, True)
    return sa


def _induce_walking(t: list[int], smaller: bytearray, seeds: list[int], starts: list[int], ends: list[int]) -> list[int]:
    """As `_induce`, suffix by suffix, for large alphabets."""
    n = len(t)
    sa, tail = [-1] * n, ends[:]
    for p in reversed(seeds):
        tail[t[p]] -= 1
        sa[tail[t[p]]] = p
    head = starts[:]
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not smaller[p]:
            c = t[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends[:]
    tail[t[-1]] -= 1
    sa[tail[t[-1]]] = n - 1
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and smaller[p]:
            c = t[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. The letters are small whole numbers; the last one is smaller than all others."""
    n, k = len(t), int(t.max()) + 1
    smaller = _types(t)
    count = np.bincount(t, minlength=k)
    ends = np.cumsum(count)
    starts = ends - count
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1  # leftmost smaller suffixes
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    if k <= BUCKETS:
        sort = lambda seeds: _induce(t, smaller, seeds, starts, ends)
    else:
        lists = t.tolist(), bytearray(smaller.tobytes()), starts.tolist(), ends.tolist()
        sort = lambda seeds: np.array(_induce_walking(lists[0], lists[1], seeds.tolist(), *lists[2:]))
    inner = np.zeros(n, dtype=bool)
    inner[left] = True
    sa = sort(left)
    ordered = sa[inner[sa]]
    size = np.ones(n, dtype=np.int64)
    size[left[:-1]] = np.diff(left) + 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    open_, at = np.flatnonzero(same), 0
    while len(open_):
        equal = t[a[open_] + at] == t[b[open_] + at]
        same[open_[~equal]] = False
        at += 1
        open_ = open_[equal]
        open_ = open_[size[a[open_]] > at]
    name = np.concatenate(([0], np.cumsum(~same)))
    if name[-1] + 1 < len(left):
        names = np.zeros(n, dtype=np.int64)
        names[ordered] = name
        ordered = left[suffix_array(names[left])]
    return sort(ordered)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, border: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each place the suffix before it in the array (-1: none) and the length of their common prefix, which ends at a letter up to `border`."""
    n = len(t)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (before[1:] < 1) | (t[:-1] <= border) | (t[:-1] != t[before[1:] - 1])
    length = np.zeros(n, dtype=np.int64)
    open_, at = np.flatnonzero(fresh & (before >= 0)), 0
    while len(open_):
        letter = t[open_ + at]
        open_ = open_[(letter == t[before[open_] + at]) & (letter > border)]
        at += 1
        length[open_] = at
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return before, length[last] - (np.arange(n) - last)


def repeated(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in the joined letters, and whether the string of `length` bytes from a place on also starts elsewhere."""
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8).astype(np.uint16) + np.uint16(2)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    joined[begins[1:] - 1] = 1  # between two texts
    t = np.append(joined, np.uint16(0))
    before, common = permuted_prefixes(t, suffix_array(t))
    found = np.zeros(len(t), dtype=bool)
    long_ = np.flatnonzero(common >= length)
    found[long_] = True
    found[before[long_]] = True
    return begins[:-1], found


# ---- runs of windows


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    gram = min(GRAM, max(1, length // 4))
    for b in batches:
        for k1, k2, raw in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("raw"), strict=True):
            raw = raw.as_buffer()
            whole, held = memoryview(raw), {}
            letters = np.frombuffer(raw, dtype=np.uint8)
            for begin in range(0, len(letters) - length + 1, CHUNK):
                end = min(begin + CHUNK, len(letters) - length + 1)
                grams = rolling(_LETTERS[letters[begin : end - 1 + length]], gram, _BASE)
                low = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
                place = (low & _PLACE).astype(np.int64)
                start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
                size = np.diff(np.append(start, end - begin)).tolist()
                anchor = grams[place[start]].view(np.int64).tolist()
                for s, n, a, at in zip((start + begin).tolist(), size, anchor, (place[start] - start).tolist(), strict=True):
                    context = xxhash.xxh3_64_intdigest(whole[s : s + n - 1 + length])
                    held.setdefault((a, context, n, at), []).append(s)
            keys = list(zip(*held, strict=True)) if held else [[]] * 4
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, k1)),
                    pa.array(np.full(n, k2)),
                    pa.array(keys[0], pa.int64()),
                    pa.array(np.array(keys[1], dtype=np.uint64).view(np.int64)),
                    pa.array(keys[2], pa.int32()),
                    pa.array(keys[3], pa.int32()),
                    pa.array(list(held.values()), pa.list_(pa.int32())),
                ],
                names=["k1", "k2", "key", "context", "size", "at", "starts"],
            )


_SAME = ["key", "context", "size", "at"]
_PIECE = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("at", pa.int32()), ("copies", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
_PIECE_DDL = "key long, context long, k1 long, k2 long, start int, size int, at int, copies long, n long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs."""
    for b in batches:
        for k1, k2, raw, wanted in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("raw"), b.column("wanted").to_pylist(), strict=True):
            raw = memoryview(raw.as_buffer())
            rows = [w | {"k1": k1, "k2": k2, "bytes": bytes(raw[w["start"] : w["start"] + w["size"] - 1 + length])} for w in wanted]
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)


def _split(batches: Iterator[pa.RecordBatch], length: int, block: int) -> Iterator[pa.RecordBatch]:
    """Each piece by blocks of `block` offsets to the anchor. The key of a part is what all windows of its block share."""
    for b in batches:
        rows = []
        for x in b.to_pylist():
            raw, at, w = x["bytes"], x["at"], 0
            while w < x["size"]:
                k = (at - w) // block  # offsets fall as windows go on
                end = min(x["size"], at - k * block + 1)
                core = raw[at - k * block : at - (k + 1) * block + 1 + length]
                part = raw[w : end - 1 + length]
                key = xxhash.xxh3_64_intdigest(core, xxhash.xxh3_64_intdigest(f"{x['key']}:{k}"))
                context = xxhash.xxh3_64_intdigest(part, 1)
                rows.append(x | {"key": key - (1 << 63), "context": context - (1 << 63), "start": x["start"] + w, "size": end - w, "at": at - w, "bytes": part if block > 1 else b""})
                w = end
        yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)


def _sorted_shard(table: pa.Table, length: int) -> pa.Table:
    """(k1, k2, begin, end) of the repeated windows of the pieces that stand in one row."""
    rows = table.select(["k1", "k2", "start", "size", "copies"]).to_pylist()
    begins, found = repeated(table.column("bytes").to_pylist(), length)
    out: list[list[int]] = [[], [], [], []]
    for x, at in zip(rows, begins.tolist(), strict=True):
        if x["copies"] > 1:
            continue
        edge = np.flatnonzero(np.diff(found[at : at + x["size"]].astype(np.int8), prepend=0, append=0))
        for w, end in edge.reshape(-1, 2).tolist():
            for column, v in zip(out, (x["k1"], x["k2"], x["start"] + w, x["start"] + end - 1 + length), strict=True):
                column.append(v)
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("k1", "k2", "begin", "end"), out, strict=True)})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for raw, spans in zip(b.column("raw"), b.column("spans").to_pylist(), strict=True):
            whole = memoryview(raw.as_buffer())
            at, reach, removed, n, digest = 0, -1, 0, 0, hashlib.sha256()
            for s, e in sorted((x["begin"], x["end"]) for x in spans or ()):
                if s > reach:
                    n += 1
                    digest.update(whole[at:s])
                    removed += e - s
                elif e > reach:
                    removed += e - reach
                at = reach = max(reach, e)
            digest.update(whole[at:])
            out.append((len(whole), removed, n, digest.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(raw).alias("k1"), F.xxhash64(F.lit("second"), raw).alias("k2"), raw.alias("raw"))


def _classes(rows: DataFrame, copies: Column) -> DataFrame:
    """key, context, size, at, copies and owner (k1, k2, start): runs of equal bytes under one key."""
    return rows.groupBy(*_SAME).agg(F.sum(copies).alias("copies"), F.min(F.struct("k1", "k2", "start")).alias("owner"))


def _forks(classes: DataFrame) -> DataFrame:
    """The classes of keys that have several, one of which stands alone; n: how many."""
    keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least")).filter("n > 1 and least = 1")
    return classes.join(keys.select("key", "n"), "key")


def repeats(base: DataFrame, length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """k1, k2, begin, end: byte ranges whose union is what is repeated in a text. `base` has k1, k2 and raw."""
    long_ = base.filter(F.length("raw") >= length).select("k1", "k2", "raw")
    runs = stored(long_.mapInArrow(partial(_runs, length=length), "k1 long, k2 long, key long, context long, size int, at int, starts array<int>"), "runs")
    shared = runs.groupBy("key").agg(F.sum(F.size("starts")).alias("n")).filter("n > 1").select("key")
    met = stored(runs.join(shared, "key", "left_semi").withColumn("start", F.get("starts", F.lit(0))), "met")
    classes = stored(_classes(met, F.size("starts")), "classes")
    range_ = lambda begin: [begin.cast("long").alias("begin"), (begin + F.col("size") - 1 + length).cast("long").alias("end")]
    many = met.join(classes.filter("copies > 1").select(*_SAME), _SAME).select("k1", "k2", "size", F.explode("starts").alias("begin"))
    spans = [many.select("k1", "k2", *range_(F.col("begin")))]
    wanted = _forks(classes).select(
        F.col("owner.k1").alias("k1"), F.col("owner.k2").alias("k2"), F.struct("key", "context", F.col("owner.start").alias("start"), "size", "at", "copies", "n").alias("w")
    )
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))  # no more than a text has runs
    texts = long_.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])
    pieces = stored(texts.mapInArrow(partial(_cut, length=length), _PIECE_DDL), "pieces")
    cold = []
    for block in LEVELS:
        cold.append(pieces.filter(F.col("n") <= hot))
        left = pieces.filter(F.col("n") > hot)
        if not left.limit(1).count():
            break
        parts = stored(left.mapInArrow(partial(_split, length=length, block=block), _PIECE_DDL).drop("n"), "parts")
        classes = stored(_classes(parts, F.col("copies")), "part-classes")
        alone = parts.filter("copies = 1").join(classes.filter("copies > 1").select(*_SAME), _SAME)
        spans.append(alone.select("k1", "k2", *range_(F.col("start"))))
        if block > 1:  # else each part is one window and its class has settled it
            one = _forks(classes).select(*_SAME, "owner.k1", "owner.k2", "owner.start", "copies", "n")
            pieces = stored(parts.drop("copies").join(one, [*_SAME, "k1", "k2", "start"]).select(*_PIECE.names), "pieces")
    cold = reduce(DataFrame.union, cold)
    total = cold.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // shard_bytes))))

    def sort_shard(table: pa.Table) -> pa.Table:
        return _sorted_shard(table, length)

    spans.append(cold.withColumn("shard", shard).groupBy("shard").applyInArrow(sort_shard, "k1 long, k2 long, begin long, end long"))
    return reduce(DataFrame.union, spans)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (remaining bytes joined).

    Texts are their UTF-8 bytes; a null text is empty. Every byte of a string of `length` bytes that also starts elsewhere,
    be it in the same row or a repeated one, is removed, the first occurrence included. Shorter texts stay whole. Rows
    are answered by their text alone, so ids may be null or repeat. An empty table gives no rows; other columns are not read.
    """
    base = _base(docs, doc_id, text)
    spans = repeats(base, length, hot, shard_bytes).distinct()
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = base.join(stored(spans, "spans"), ["k1", "k2"], "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
