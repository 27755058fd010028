"""LM scoring by a subword lattice.

The vocabulary is the one of an existing piece model. Its scores order the pieces; a Zipf law over that order is the
first guess of their probabilities, and one round of expectation maximisation over all training words (forward and backward
over all segmentations) makes them the model's unigram weights. The probability of a word is the sum over all its segmentations,
by the forward recursion in log space; that of a text is the product over its words and the end of the text.

Words are counted once for the whole corpus and scored once each. The HEAD most frequent words travel to the tasks as
a bounded table; a document's other words meet their scores by a join, which has no hot key for that very reason.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored
from pitloom.llm.piece_codec import SPACE, codec, default_model

#: Words held by every task at most (whole levels of frequency, from the top); the others are joined.
HEAD = 200_000
#: Words that a counting task holds before it passes them on.
HELD = 300_000
#: Weight of the first guess in the re-estimated piece probabilities, in pieces.
PRIOR = 1000.0
ZIPF_SHIFT = 2.7
ADDED = 0.1
END = b""


class Lattice:
    """All segmentations of a word into the pieces of a model; a character that is no piece is spelt in bytes."""

    def __init__(self, model: str):
        self.codec = c = codec(model)
        order = sorted(c.ids.values(), key=lambda i: (c.rank[i] if c.rank[i] >= 0 else 0.5 * len(c.pieces), i))
        self.size = len(c.pieces) + 1
        self.end = self.size - 1
        place = {i: k for k, i in enumerate(order)}
        guess = np.zeros(self.size)
        for i in c.ids.values():
            guess[i] = 1.0 / (place[i] + 1 + ZIPF_SHIFT)
        for i in c.byte_ids:
            guess[i] = 1.0 / (self.size + ZIPF_SHIFT)
        guess[self.end] = guess.max() / 10
        self.guess = guess / guess.sum()

    def edges(self, word: bytes, log_p) -> tuple[int, list[tuple[int, int, tuple | int, float]]]:
        """(length, edges (start, end, piece or bytes, log probability) by end)."""
        c = self.codec
        text = SPACE + word.decode("utf-8", "replace")
        found = []
        if c.known.issuperset(text):
            for e, (token, n) in c.automaton.iter(text):
                found.append((e + 1 - n, e + 1, token, log_p[token]))
            return len(text), found
        begin = 0
        for at, x in enumerate(text + "\x00"):
            if at < len(text) and x in c.known:
                continue
            if at > begin:
                for e, (token, n) in c.automaton.iter(text[begin:at]):
                    found.append((begin + e + 1 - n, begin + e + 1, token, log_p[token]))
            if at < len(text):
                spelt = tuple(c.byte_ids[b] for b in x.encode())
                found.append((at, at + 1, spelt, sum(log_p[i] for i in spelt)))
            begin = at + 1
        return len(text), found

    @staticmethod
    def forward(n: int, edges) -> list[float]:
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for start, end, _, p in edges:
            v, a = alpha[start] + p, alpha[end]
            if a == -math.inf:
                alpha[end] = v
            else:
                alpha[end] = v + log1p(exp(a - v)) if v > a else a + log1p(exp(v - a))
        return alpha

    def log_probability(self, word: bytes, log_p) -> float:
        """Natural logarithm of the sum over all segmentations."""
        n, edges = self.edges(word, log_p)
        return self.forward(n, edges)[n]

    def expect(self, word: bytes, times: int, log_p, total: np.ndarray) -> None:
        """Adds the expected uses of each piece in `times` occurrences of a word."""
        n, edges = self.edges(word, log_p)
        alpha = self.forward(n, edges)
        beta = [-math.inf] * (n + 1)
        beta[n] = 0.0
        exp, log1p, whole = math.exp, math.log1p, alpha[n]
        for start, end, token, p in reversed(edges):
            b = beta[end]
            if b == -math.inf:
                continue
            v, a = b + p, beta[start]
            if a == -math.inf:
                beta[start] = v
            else:
                beta[start] = v + log1p(exp(a - v)) if v > a else a + log1p(exp(v - a))
            share = times * exp(alpha[start] + v - whole)
            if type(token) is int:
                total[token] += share
            else:
                for i in token:
                    total[i] += share


@lru_cache(maxsize=2)
def lattice(model: str) -> Lattice:
    return Lattice(model)


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower and bytes.split know ASCII alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train: Counter = Counter()
    held: Counter = Counter()

    def rows():
        words = [*train, *(w for w in held if w not in train)]
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([train.get(w, 0) for w in words], pa.int64()), pa.array([held.get(w, 0) for w in words], pa.int64())],
            names=["word", "train", "held"],
        )

    for b in batches:
        for out, text in zip(b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
            into = held if out else train
            into.update(tokens_of(text))
            into[END] += 1
            if len(train) + len(held) > HELD:
                yield rows()
                train.clear()
                held.clear()
    yield rows()


def _expect(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    lat = lattice(model)
    log_p = np.log(np.maximum(lat.guess, 1e-300)).tolist()
    total = [0.0] * lat.size
    for b in batches:
        for word, n in zip(b.column("word").to_pylist(), b.column("train").to_pylist(), strict=True):
            if not word:
                total[lat.end] += n
            elif n:
                lat.expect(word, n, log_p, total)
    at = [i for i, x in enumerate(total) if x]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[i] for i in at], pa.float64())], names=["piece", "uses"])


def _score_words(batches: Iterator[pa.RecordBatch], model: str, log_p: np.ndarray) -> Iterator[pa.RecordBatch]:
    lat = lattice(model)
    held = log_p.tolist()
    for b in batches:
        scores = [(lat.log_probability(w, held) if w else held[lat.end]) / math.log(10) for w in b.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("train"), b.column("held"), pa.array(scores, pa.float64())], names=["word", "train", "held", "score"])


def _score_docs(batches: Iterator[pa.RecordBatch], head: tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    place = {w: i for i, w in enumerate(head[0])}
    known, base, score = (x.tolist() for x in head[1:])
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    for b in batches:
        out: list[tuple] = []
        for text in b.column("text").to_pylist():
            words = tokens_of(text)
            words.append(END)
            n_known, sum_base, sum_score, tail = 0, 0.0, 0.0, []
            for w, n in Counter(words).items():
                at = place.get(w)
                if at is None:
                    tail.append({"word": w, "n": n})
                else:
                    n_known += n * known[at]
                    sum_base += n * base[at]
                    sum_score += n * score[at]
            out.append((len(words), n_known, sum_base, sum_score, tail))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), tail_type)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("held_out"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail"],
        )




def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text divides by 10; a null id counts as the empty text, which does."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_documents(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are logarithms to base 10; base_score is the add-0.1 word model, score the lattice model. A null text is
    empty: its only token is the end. Repeated rows are answered (and learnt from) each; with no training row all
    counts are 0 and the pieces keep their first guess. An empty table gives no rows; other columns are not read.
    """
    model = model or default_model()
    lat = lattice(model)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id).cast("long")).alias("held_out"), F.col(text).cast("string").alias("text"))
    counted = base.select("held_out", "text").mapInArrow(_count, "word binary, train long, held long")
    words = stored(counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held")), "words")
    n, v = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    uses = np.zeros(lat.size)
    expected = words.filter("train > 0").select("word", "train").mapInArrow(partial(_expect, model=model), "piece long, uses double")
    for piece, x in expected.groupBy("piece").agg(F.sum("uses")).collect():  # a row for each piece of the vocabulary at most
        uses[piece] = x
    log_p = np.log(np.maximum((uses + PRIOR * lat.guess) / (uses.sum() + PRIOR), 1e-300))
    scored = words.mapInArrow(partial(_score_words, model=model, log_p=log_p), "word binary, train long, held long, score double")
    below = F.lit(float(n) + ADDED * (v + 1))
    scored = stored(scored.withColumn("base", F.log10((F.col("train") + F.lit(ADDED)) / below)), "scored-words")
    level = F.floor(F.ln(F.col("train") + F.col("held")) * 16)
    left, cut = head, None
    for at, size in sorted(scored.groupBy(level).count().collect(), reverse=True):  # a row for each sixteenth of a power of e
        left -= size
        if left < 0:
            break
        cut = at
    top = scored.filter(level >= cut if cut is not None else F.lit(False)).select("word", "train", "base", "score").toArrow()
    table = (
        top.column("word").to_pylist(),
        (top.column("train").to_numpy() > 0).astype(np.int64),
        top.column("base").to_numpy(),
        top.column("score").to_numpy(),
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word: binary, n: long>>"
    parts = base.mapInArrow(partial(_score_docs, head=table), schema).withColumn("row", F.monotonically_increasing_id())
    parts = stored(parts, "scored-docs")
    rest = parts.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("n"))
    rest = rest.join(scored.select("word", "train", F.col("base").alias("b"), F.col("score").alias("s")), "word")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("s")).alias("s"))
    found = parts.drop("tail").join(rest, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(F.col(b), F.lit(zero))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("n_known", "k", 0).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        plus("base", "b", 0.0).alias("base_score"),
        plus("score", "s", 0.0).alias("score"),
    )
