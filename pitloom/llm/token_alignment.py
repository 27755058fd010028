"""Alignment of two tokenizers by the byte offsets where tokens of both end.

Each text is encoded by a byte-level tokenizer (A, over a space and the text) and by a piece tokenizer (B, which adds the space
itself). The cumulative byte ends of either side go into a dictionary from end to index; the sorted intersection of the
two key sets cuts both id lists into groups, and each group is expanded to its links: the pairs of tokens whose byte ranges overlap,
one for each stretch between neighbouring ends of either side.

How many documents link a pair of ids is counted over the corpus. The documents keep their different pairs; the most
frequent pairs, HEAD at most, and the highest count of each A id (a row for each id of the vocabulary) go to every task,
and only the rare rest of the pairs is joined. Rare pairs have few rows each, so no key of that join is hot.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored

#: Pairs that every task receives with their counts.
HEAD = 1 << 20
#: Texts without such characters are split alike by both libraries for A, whatever their version of Unicode.
NOT_COMMON = re.compile(r"[^\u0000-\u058F]")
#: Code points that are handed to the tokenizers at once.
AT_ONCE = 50_000


def default_tokenizers() -> tuple[str, str, str | None]:
    """Paths of the public byte-level vocabulary (A), the piece model (B) and A's vocabulary as ranks, where the tokenizer files are installed."""
    import public_tokenizers

    return tuple(public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it can be printed, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


_NONE = np.zeros(0, dtype=np.int64)


class Pair:
    """Both tokenizers with the bytes of their tokens. `ranks`, if given, is A's vocabulary for a faster library, used on common letters."""

    def __init__(self, path_a: str, path_b: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[x] for x in name) if all(x in letters for x in name) else name.encode()
        self.bytes_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(x): int(i) for x, i in map(bytes.split, f)}
            if all(self.bytes_a[i] == x for x, i in table.items()):
                self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        # what is written for a token of A inside and at the end of its group, and for one of B
        self.shown = np.array([f"{i}{end}" for size, last in ((self.size_a, "|"), (self.size_b, ";")) for end in (",", last) for i in range(size)], dtype=object)
        self.bytes_a, self.bytes_b = np.array(self.bytes_a, dtype=object), np.array(self.bytes_b, dtype=object)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides; no ids for a text that either does not keep whole."""
        led = [" " + t for t in texts]
        other = [t for t in led if not self.fast or NOT_COMMON.search(t)]
        slow = dict(zip(other, (e.ids for e in self.a.encode_batch_fast(other, add_special_tokens=False)), strict=True)) if other else {}
        for text, b in zip(led, self.b.encode(texts, num_threads=1), strict=True):
            want = text.encode("utf-8", "surrogatepass")
            a = np.array(slow[text], dtype=np.int64) if text in slow else self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            b = np.array(b, dtype=np.int64)
            whole = len(text) > 1 and all(b"".join(names[ids].tolist()) == want for ids, names in ((b, self.bytes_b), (a, self.bytes_a)))
            yield (a, b) if whole else (_NONE, _NONE)

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[int, str, np.ndarray]:
        """Number of groups, the groups in writing, and the pair (A id * size of B + B id) of each link."""
        if not len(ids_a):
            return 0, "", _NONE
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        at_a, at_b = (dict(zip(ends.tolist(), range(len(ends)), strict=True)) for ends in (ends_a, ends_b))
        common = sorted(at_a.keys() & at_b.keys())
        last_a, last_b = (np.fromiter(map(at.__getitem__, common), dtype=np.int64, count=len(common)) for at in (at_a, at_b))
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        # a group's tokens of A, then those of B
        written = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        codes = ids_a.copy()
        codes[last_a] += self.size_a
        written[np.arange(len(ids_a)) + np.repeat(last_b + 1 - n_b, n_a)] = codes
        codes = ids_b + 2 * self.size_a
        codes[last_b] += self.size_b
        written[np.arange(len(ids_b)) + np.repeat(last_a + 1, n_b)] = codes
        # the links of a group: the tokens on both sides of each stretch between neighbouring ends
        own = np.ones(len(ids_b), dtype=bool)
        own[last_b] = False
        ends = np.sort(np.concatenate((ends_a, ends_b[own])), kind="stable")
        pairs = ids_a[np.searchsorted(ends_a, ends)] * self.size_b + ids_b[np.searchsorted(ends_b, ends)]
        return len(common), "".join(self.shown[written].tolist())[:-1], pairs


@lru_cache(maxsize=2)
def tokenizer_pair(path_a: str, path_b: str, ranks: str | None = None) -> Pair:
    """One for each Python worker."""
    return Pair(path_a, path_b, ranks)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, AT_ONCE code points or a single text at once."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _aligned(batches: Iterator[pa.RecordBatch], paths: tuple[str, ...], wide: bool) -> Iterator[pa.RecordBatch]:
    both = tokenizer_pair(*paths)
    kind = pa.int64() if wide else pa.int32()
    for whole in batches:
        at = 0
        for texts in _slices([t or "" for t in whole.column("text").to_pylist()]):
            b = whole.slice(at, len(texts))
            at += len(texts)
            rows: list[tuple] = []
            for x, y in both.encode(texts):
                n, written, links = both.align(x, y)
                pairs, times = np.unique(links, return_counts=True)
                rows.append((len(x), len(y), n, len(links), hashlib.sha256(written.encode()).hexdigest() if n else "", pairs, times))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(kind), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )


def _looked_up(batches: Iterator[pa.RecordBatch], head: np.ndarray, counts: np.ndarray, best: np.ndarray, size_b: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs that `head` holds, and the pairs that it does not hold."""
    for b in batches:
        lists = b.column("pairs")
        pairs, times = lists.flatten().to_numpy().astype(np.int64), b.column("times").flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        place = np.minimum(np.searchsorted(head, pairs), max(len(head) - 1, 0))
        known = head[place] == pairs if len(head) else np.zeros(len(pairs), dtype=bool)
        n = counts[place[known]]
        total, top = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
        np.add.at(total, row[known], n * times[known])
        np.add.at(top, row[known], np.where(n == best[pairs[known] // size_b], times[known], 0))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~known], minlength=b.num_rows)))), pa.int32())
        rest = pa.ListArray.from_arrays(ends, pa.array(pairs[~known], pa.int64() if wide else pa.int32()))
        rest_times = pa.ListArray.from_arrays(ends, pa.array(times[~known], pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in _KEPT), pa.array(top), pa.array(total), rest, rest_times], names=[*_KEPT, "n_best", "count_sum", "pairs", "times"]
        )


_KEPT = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def align(docs: DataFrame, tokenizers: tuple[str, ...] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups of each row, stored: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * size of B + B id) and times."""
    paths = tokenizers or default_tokenizers()
    both = tokenizer_pair(*paths)
    wide = both.size_a * both.size_b > 1 << 31
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "long" if wide else "int"
    rows = base.mapInArrow(
        partial(_aligned, paths=paths, wide=wide),
        f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, times array<int>",
    )
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, count: how many rows hold a pair linked."""
    return stored(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")), "pair-counts")


def align_tokenizers(docs: DataFrame, tokenizers: tuple[str, ...] | None = None, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair has the highest count among the pairs of their A id, ties included; count_sum adds up the
    counts of all links. A text that is null, empty or not kept whole by both sides has no tokens: zeros and an
    empty digest. A null id stays null; repeated rows are answered (and counted) each; an empty table gives no rows;
    other columns are neither read nor returned.
    """
    paths = tokenizers or default_tokenizers()
    both = tokenizer_pair(*paths)
    wide = both.size_a * both.size_b > 1 << 31
    kind = "long" if wide else "int"
    rows = align(docs, paths, doc_id, text)
    counts = link_counts(rows)
    in_a = F.floor(F.col("pair") / both.size_b).cast("int")
    best = np.zeros(both.size_a, dtype=np.int64)
    highest = counts.groupBy(in_a.alias("a")).agg(F.max("count").alias("best"))
    for a, n in highest.collect():  # a row for each id of A at most
        best[a] = n
    level = F.floor(F.log2("count") * 8)
    left, cut = head, None
    for at, size in sorted(counts.groupBy(level).count().collect(), reverse=True):  # eight rows for each power of two
        left -= size
        if left < 0:
            break
        cut = at
    top = counts.filter(level >= cut if cut is not None else F.lit(False)).orderBy("pair").toArrow()  # HEAD rows at most
    table = [top.column(c).to_numpy().astype(np.int64) for c in ("pair", "count")]
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<{kind}>, times array<int>"
    parts = rows.mapInArrow(partial(_looked_up, head=table[0], counts=table[1], best=best, size_b=both.size_b, wide=wide), schema)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if left >= 0:
        return parts.select(*names)
    parts = stored(parts, "looked-up")
    rare = counts.filter(level < cut if cut is not None else F.lit(True)).withColumn("a", in_a).join(F.broadcast(highest), "a")
    rare = rare.select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    rest = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("t"), F.sum(F.col("times") * F.col("count")).alias("s"))
    found = parts.drop("pairs", "times").join(rest, "row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return found.select(*(plus(c, {"n_best": "t", "count_sum": "s"}[c]) if c in ("n_best", "count_sum") else F.col(c) for c in names))
