"""Grouping of spelling variants by Bloom-guided neighbourhoods.

1. Words are counted in the tasks that read the texts and summed by word; rare and short ones go.
2. The vocabulary is cut into shards by length, and a length of many words by hash into more of them. Each shard becomes a
   split-block Bloom filter of a bounded size, built where its hashes meet.
3. Filters are handed to all tasks in rounds of FILTER_BYTES at most; a small vocabulary takes one round. In a round each
   word's edits are tried against the filter of their length: its deletions, which find pairs of neighbouring
   lengths from the longer side, and its replacements by a later letter, which find pairs of one length once. An edit's hash is
   the word's hash with one letter's part changed, so no string is made for it.
4. Only the edits that a filter lets pass are written out and joined with the vocabulary, which removes the false ones.
5. A word's form is its most frequent near word if that is frequent enough. Forms at least double the count, so
   their chains are short; they are followed by pointer jumping.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored
from pitloom.llm.words import U, mix

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: A run loses a letter if this divides its checksum.
NOISE = 97
RUN = re.compile(rb"[A-Za-z\xC0-\xFF]+")
#: Words that a task counts before it passes them on.
HELD = 200_000
#: Words that share a shard, bits of filter for each, bytes of filters in one round, and the length from which words share their shards.
SHARD_WORDS, BITS, FILTER_BYTES, LONG = 1 << 18, 32, 1 << 25, 64
LANES = 8
_SALTS = (mix(np.arange(1, LANES + 1, dtype=np.uint64)) & U(0xFFFFFFFF)) | U(1)
#: Letters of words whose edits are tried at once.
AT_ONCE = 1 << 15


def _count(batches: Iterator[pa.RecordBatch], least_length: int) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            begin = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            # one byte for each code point; those beyond U+00FF are no letters; bytes.lower knows A-Z alone
            for run, n in Counter(RUN.findall((text or "").encode("latin-1", "replace").lower())).items():
                h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                if h % NOISE == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= least_length:
                    held[run] += n
            if len(held) > HELD:
                yield rows()
                held.clear()
    yield rows()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts, stored."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = base.mapInArrow(partial(_count, least_length=least_length), "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "vocabulary")


def part(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to a word's hash."""
    return mix(place.astype(np.uint64) * U(256) + letter.astype(np.uint64) + U(0x51ED2701))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `words`, letters as a matrix) for each length, AT_ONCE letters or one word at most."""
    raw = [w.encode("latin-1") for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    for n in np.unique(size).tolist():
        same = np.flatnonzero(size == n)
        step = max(1, AT_ONCE // max(n, 1))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            yield some, np.frombuffer(b"".join([raw[i] for i in some.tolist()]), dtype=np.uint8).reshape(len(some), n)


def _hashes(batches: Iterator[pa.RecordBatch], slices: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, letters in by_length(b.column("word").to_pylist()):
            n, length = letters.shape
            shard = min(length, LONG)
            h = mix(part(np.arange(length), letters).sum(axis=1, dtype=np.uint64))
            where = (mix(h + U(1)) % U(slices[shard])).astype(np.int32)
            used = [b""] * n
            some, first = np.unique(where, return_index=True)
            for own, at in zip(some.tolist(), first.tolist(), strict=True):  # the letters of a shard's words travel with one of them
                used[at] = np.unique(letters[where == own]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard, dtype=np.int32)), pa.array(where), pa.array(h.view(np.int64)), pa.array(used, pa.binary())],
                names=["length", "slice", "hash", "letters"],
            )


def lanes_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the lower half from which the bits of its lanes come."""
    return ((h >> U(32)) % U(blocks)).astype(np.int64), h & U(0xFFFFFFFF)


def bit(low: np.ndarray, lane: int) -> np.ndarray:
    return np.uint32(1) << (((low * _SALTS[lane]) & U(0xFFFFFFFF)) >> U(27)).astype(np.uint32)


def _build(table: pa.Table, blocks: dict[int, int]) -> pa.Table:
    length = table.column("length")[0].as_py()
    block, low = lanes_of(table.column("hash").to_numpy().view(np.uint64), blocks[length])
    bloom = np.zeros((blocks[length], LANES), dtype=np.uint32)
    for k in range(LANES):
        np.bitwise_or.at(bloom[:, k], block, bit(low, k))
    letters = bytes(sorted(set(b"".join(table.column("letters").to_pylist()))))
    return pa.table({"length": pa.array([length], pa.int32()), "slice": table.column("slice").slice(0, 1), "bloom": pa.array([bloom.tobytes()], pa.binary()), "letters": pa.array([letters], pa.binary())})


class Filters:
    """The filters of one round: for a length the slices from `first` on."""

    def __init__(self, slices: dict[int, int], blocks: dict[int, int], rows: list[dict]):
        self.slices, self.held = slices, {}
        for length in sorted({r["length"] for r in rows}):
            own = sorted((r for r in rows if r["length"] == length), key=lambda r: r["slice"])
            places = np.full(slices[length], -1)
            places[[r["slice"] for r in own]] = np.arange(len(own))
            bloom = np.stack([np.frombuffer(r["bloom"], dtype=np.uint32).reshape(blocks[length], LANES) for r in own])
            self.held[length] = places, bloom, sorted(set(b"".join(r["letters"] for r in own)))

    def letters(self, length: int) -> list[int]:
        held = self.held.get(min(length, LONG))
        return held[2] if held else []

    def passing(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places in `h` that the filters of a length let pass."""
        shard = min(length, LONG)
        places, bloom, _ = self.held[shard]
        own = places[(mix(h + U(1)) % U(self.slices[shard])).astype(np.int64)]
        left = np.flatnonzero(own >= 0)
        own = own[left]
        block, low = lanes_of(h[left], bloom.shape[1])
        for k in range(LANES):
            good = (bloom[own, block, k] & bit(low, k)) != 0
            left, own, block, low = left[good], own[good], block[good], low[good]
        return left


def _edits(letters: np.ndarray, filters: Filters, least_length: int) -> Iterator[tuple[int, bytes]]:
    """(word, edit) of the deletions and of the replacements by a later letter that pass the filters, for words of one length."""
    n, length = letters.shape
    parts = part(np.arange(length), letters)
    total = parts.sum(axis=1, dtype=np.uint64)
    if length > least_length and filters.letters(length - 1):
        before = np.cumsum(parts, axis=1, dtype=np.uint64) - parts
        moved = part(np.maximum(np.arange(length) - 1, 0), letters)
        after = moved.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(moved, axis=1, dtype=np.uint64)
        first = np.ones((n, length), dtype=bool)  # of equal neighbours the first stands for all
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        word, place = np.nonzero(first)
        for i in filters.passing(length - 1, mix((before + after)[word, place])).tolist():
            w, p = int(word[i]), int(place[i])
            raw = letters[w].tobytes()
            yield w, raw[:p] + raw[p + 1 :]
    rest = total[:, None] - parts
    for letter in filters.letters(length):
        word, place = np.nonzero(letters < letter)
        if len(word):
            other = part(np.arange(length), np.full(length, letter))
            for i in filters.passing(length, mix(rest[word, place] + other[place])).tolist():
                w, p = int(word[i]), int(place[i])
                raw = letters[w].tobytes()
                yield w, raw[:p] + bytes([letter]) + raw[p + 1 :]


def _probe(batches: Iterator[pa.RecordBatch], filters: Filters, least_length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, counts = b.column("word").to_pylist(), b.column("n").to_pylist()
        for places, letters in by_length(words):
            found = list(_edits(letters, filters, least_length))
            at = [int(places[w]) for w, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in at], pa.string()), pa.array([counts[i] for i in at], pa.int64()), pa.array([x.decode("latin-1") for _, x in found], pa.string())],
                names=["word", "n", "near"],
            )


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, shard_words: int = SHARD_WORDS, filter_bytes: int = FILTER_BYTES, bits: int = BITS) -> DataFrame:
    """word, n, near, near_n: each pair of words that differ by one code point, once. `words` has word and n and is read more than once."""
    size = {r[0]: r[1] for r in words.groupBy(F.least(F.length("word"), F.lit(LONG))).count().collect()}  # LONG rows at most
    slices = {k: -(-n // shard_words) for k, n in size.items()}
    blocks = {k: max(1, -(-n * bits // (slices[k] * LANES * 32))) for k, n in size.items()}
    hashed = words.select("word").mapInArrow(partial(_hashes, slices=slices), "length int, slice int, hash long, letters binary")

    def build(table: pa.Table) -> pa.Table:
        return _build(table, blocks)

    built = hashed.groupBy("length", "slice").applyInArrow(build, "length int, slice int, bloom binary, letters binary")
    built = stored(built, "filters")
    rounds, left = [], 0
    for k in sorted(size):
        for s in range(slices[k]):
            left -= blocks[k] * LANES * 4
            if left < 0:
                rounds.append({})
                left = filter_bytes - blocks[k] * LANES * 4
            rounds[-1].setdefault(k, []).append(s)
    found = []
    for own in rounds:
        rows = built.filter(reduce(lambda a, b: a | b, ((F.col("length") == k) & F.col("slice").between(s[0], s[-1]) for k, s in own.items()))).collect()  # filter_bytes at most
        filters = Filters(slices, blocks, [r.asDict() for r in rows])
        some = words.filter(F.length("word") >= min(own)) if max(own) >= LONG else words.filter(F.length("word").between(min(own), max(own) + 1))
        found.append(stored(some.mapInArrow(partial(_probe, filters=filters, least_length=least_length), "word string, n long, near string"), "edits"))
    if not found:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    edits = reduce(DataFrame.union, found)
    return edits.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. `forms` has word and form, never null."""
    top = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = top.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(top.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        top = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return top


def group_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, **sizes: int
) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters with A-Z in lower case, some with a letter taken out by a checksum of the row's id
    and the run. The form is the near word of largest n (ties: the smallest) if its n is `factor` times the word's
    or more, else null. A null or empty text has no words; a null id counts as an empty one; repeated rows count
    each; an empty table gives no rows; other columns are not read. `sizes` go to `near_words`.
    """
    words = vocabulary(docs, doc_id, text, least_length, least_count)
    pairs = stored(near_words(words, least_length, **sizes), "near-words")
    ways = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    found = stored(found, "forms")
    found = found.join(roots(found.filter("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
