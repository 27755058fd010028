"""Language identification by Bayesian evidence fusion.

    posterior(l)  ~  P(text | l)  *  P(declared | l)  *  P(l | host)

* text: letter trigrams, hashed to a fixed number of counters; the model is counted over all rows that declare a
  language, so nothing is sampled. Every declared primary subtag with LEAST_ROWS rows or more has a model.
* declared markup language: a confusion table of declared against text language, counted over all rows.
* host: the text languages of a host's other rows, smoothed towards its address suffix, which is smoothed towards
  the whole corpus. Counts come from grouped aggregation and are joined by host and suffix; AQE splits a hot host.

Models are handed to tasks in blocks of BLOCK languages, so their size is bounded whatever the number of languages. A row keeps the
languages that are less likely than its best one by RANGE (natural logarithm) at most: no prior of the fusion is as small
as exp(-RANGE), so the others can neither win nor be seen in a posterior. What the driver holds besides is a row for each
language and for each pair of declared and text language that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import row_key, stored

#: Rows that a language needs, languages in one model, and how much less likely than the best one a language may be to be kept.
LEAST_ROWS, BLOCK, RANGE = 3, 512, 200.0
#: Languages that a task counts before it passes them on.
HELD = 64
COUNTERS = 1 << 14
SMOOTHING = 0.5
#: Part of the uniform distribution in a language's model: a trigram never seen costs a factor of this against no model, so a key or
#: an address in a short text does not decide about it.
UNIFORM = 0.1
HOST_WEIGHT, SUFFIX_WEIGHT, CORPUS_WEIGHT = 20.0, 50.0, 1.0
#: A posterior below this is undetermined.
LEAST_POSTERIOR = 0.5
#: From so many trigrams on, a text whose trigrams are on average so much less likely (natural logarithm) under its language than
#: under no model at all is undetermined; trigrams never seen cost ln 10 each, so more than two in five must be foreign.
LEAST_TRIGRAMS, ALIEN = 20, 1.0
UNDETERMINED = "und"

_FLAT = np.array([chr(c).isalpha() for c in range(0x250)])


def trigrams(text: str | None) -> np.ndarray:
    """Counter of each trigram of the lower-cased letters; what is no letter is one space."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = points < 0x250
    letter = np.where(low, _FLAT[np.where(low, points, 0)], points < 0x1F000)
    letter &= (points < 0x2000) | (points > 0x2BFF)
    points = np.where(letter, points, 32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = points[keep].astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, dtype=np.int64)
    code = (points[:-2] * np.uint64(0x1F123BB5) + points[1:-1] * np.uint64(0x9E3779B1) + points[2:] * np.uint64(0x85EBCA77)) * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(50)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(languages)}
    held: dict[int, np.ndarray] = {}

    def rows():
        lang = np.concatenate([np.full(np.count_nonzero(n), i) for i, n in held.items()] or [np.zeros(0, dtype=np.int64)])
        slot = np.concatenate([np.flatnonzero(n) for n in held.values()] or [np.zeros(0, dtype=np.int64)])
        n = np.concatenate([n[n > 0] for n in held.values()] or [np.zeros(0, dtype=np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(slot, pa.int64()), pa.array(n, pa.int64())], names=["lang", "slot", "n"])

    for b in batches:
        for lang, text in zip(b.column("declared").to_pylist(), b.column("text").to_pylist(), strict=True):
            if lang in place:
                n = np.bincount(trigrams(text), minlength=COUNTERS)
                held[place[lang]] = held[place[lang]] + n if place[lang] in held else n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
    yield rows()


def _near(place: np.ndarray, likelihood: np.ndarray) -> tuple[list[int], list[float]]:
    near = likelihood >= likelihood.max() - RANGE
    return place[near].tolist(), likelihood[near].tolist()


def _score(batches: Iterator[pa.RecordBatch], model: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
    """Adds the languages of one block, numbered from `first` on, to those that earlier blocks have kept."""
    own = np.arange(first, first + model.shape[1])
    for b in batches:
        places, values, sizes = [], [], []
        for text, place, value in zip(b.column("text").to_pylist(), b.column("place").to_pylist(), b.column("likelihood").to_pylist(), strict=True):
            grams = trigrams(text)
            sizes.append(len(grams))
            now = model[grams].sum(axis=0, dtype=np.float64)
            kept = _near(np.concatenate((np.array(place, dtype=np.int64), own)), np.concatenate((np.array(value, dtype=np.float64), now)))
            places.append(kept[0])
            values.append(kept[1])
        done = {"n_trigrams": pa.array(sizes, pa.int64()), "place": pa.array(places, pa.list_(pa.int32())), "likelihood": pa.array(values, pa.list_(pa.float64()))}
        yield pa.RecordBatch.from_arrays([done.get(c, b.column(i)) for i, c in enumerate(b.schema.names)], names=b.schema.names)


def _fuse(batches: Iterator[pa.RecordBatch], languages: list[str], confusion: dict[tuple[int, int], int], known: dict[int, int], corpus: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """`confusion`: rows by (text language, declared language); `known`: their sums by text language; `corpus`: rows by text language."""
    at = {x: i for i, x in enumerate(languages)}
    size, total = len(languages), sum(corpus.values())
    flat = np.log(1.0 / COUNTERS)
    for b in batches:
        out: list[tuple] = []
        rows = [b.column(c).to_pylist() for c in ("declared", "n_trigrams", "place", "likelihood", "text_place", "host_counts", "suffix_counts")]
        for declared, n, place, likelihood, own, at_host, at_suffix in zip(*rows, strict=True):
            if not place:
                out.append((UNDETERMINED, None, 0.0, False))
                continue
            less = np.array([i == own for i in place], dtype=float)  # a row is no evidence for itself
            one = 0 if own is None else 1

            def others(counts):
                return np.array([counts.get(i, 0) for i in place], dtype=float) - less

            at_host, at_suffix = dict(at_host or ()), dict(at_suffix or ())
            whole = (others(corpus) + CORPUS_WEIGHT / size) / (total - one + CORPUS_WEIGHT)
            suffix = (others(at_suffix) + SUFFIX_WEIGHT * whole) / (sum(at_suffix.values()) - one + SUFFIX_WEIGHT)
            prior = (others(at_host) + HOST_WEIGHT * suffix) / (sum(at_host.values()) - one + HOST_WEIGHT)
            text = np.array(likelihood)
            score = text + np.log(prior)
            if declared in at:
                score = score + np.log([(confusion.get((i, at[declared]), 0) + 1) / (known.get(i, 0) + size) for i in place])
            odds = np.exp(score - score.max())
            odds /= odds.sum()
            best = int(odds.argmax())
            alien = n >= LEAST_TRIGRAMS and text[best] < n * (flat - ALIEN)
            fine = n > 0 and odds[best] >= LEAST_POSTERIOR and not alien
            out.append((languages[place[best]] if fine else UNDETERMINED, None if own is None else languages[own], float(odds[best]), fine))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        types = (pa.string(), pa.string(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("row_key"), b.column("declared"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            names=["doc_id", "row_key", "declared", "lang", "text_lang", "posterior", "accepted"],
        )


def host_of(url: Column) -> Column:
    """Host of an address, or the string itself where it is no address; null is empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1))


def primary(code: Column) -> Column:
    """Primary subtag of a language code in lower case: "en-US" and "en_GB" are "en"; an empty one is null."""
    tag = F.lower(F.regexp_extract(code, r"^\s*([A-Za-z0-9]+)", 1))
    return F.when(tag != "", tag)


def markup_language(html: Column) -> Column:
    """Primary language subtag that an html element declares, wherever it stands, or null."""
    return primary(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html(?=\s)[^>]*?\slang\s*=\s*[\"']?([a-zA-Z0-9_-]+)", 1))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: Column | None = None, address: Column | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: doc_id, row_key, declared, lang, text_lang, posterior, accepted.

    `declared` and `address` are expressions over `docs` (null where there is no such evidence); of a declared code the
    primary subtag counts. A row without a letter
    is undetermined ("und") and not accepted, so are null and empty texts; ties go to the language that comes first
    by number of declaring rows, then by name. If no row declares a language there is no model and all rows are
    undetermined. Repeated rows are answered each; other columns are not read; an empty table gives no rows.
    """
    host = host_of(address) if address is not None else F.lit("")
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        row_key(F.col(doc_id), F.col(text)).alias("row_key"),
        (primary(declared) if declared is not None else F.lit(None).cast("string")).alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"),
        F.col(text).cast("string").alias("text"),
    )
    counts = base.filter("declared is not null").groupBy("declared").count().filter(F.col("count") >= LEAST_ROWS).collect()  # a row for each language
    languages = [r["declared"] for r in sorted(counts, key=lambda r: (-r["count"], r["declared"]))]
    size = len(languages)
    counted = base.select("declared", "text").mapInArrow(partial(_count, languages=languages), "lang long, slot long, n long")
    counted = stored(counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")), "trigram-counts")
    scored = base.withColumns({"n_trigrams": F.lit(0).cast("long"), "place": F.array().cast("array<int>"), "likelihood": F.array().cast("array<double>")})
    for first in range(0, size, block):
        some = counted.filter(F.col("lang").between(first, first + block - 1)).toArrow()  # BLOCK x COUNTERS rows at most
        table = np.full((min(block, size - first), COUNTERS), SMOOTHING)
        table[some.column("lang").to_numpy() - first, some.column("slot").to_numpy()] += some.column("n").to_numpy()
        model = np.log((1 - UNIFORM) * table / table.sum(axis=1, keepdims=True) + UNIFORM / COUNTERS)
        scored = scored.mapInArrow(partial(_score, model=np.ascontiguousarray(model.T.astype(np.float32)), first=first), scored.schema)
    best = F.when(F.col("n_trigrams") > 0, F.get("place", (F.array_position("likelihood", F.array_max("likelihood")) - 1).cast("int")))
    scored = stored(scored.drop("text").withColumn("text_place", best), "evidence")
    met = scored.filter("text_place is not null")

    def by(key: str) -> DataFrame:
        n = met.groupBy(key, "text_place").agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("text_place", "n"))).alias(f"{key}_counts"))

    corpus = {r["text_place"]: r["count"] for r in met.groupBy("text_place").count().collect()}  # a row for each language
    at = {x: i for i, x in enumerate(languages)}
    pairs = met.filter("declared is not null").groupBy("text_place", "declared").count().collect()  # a row for each pair of languages that occurs
    confusion = {(r["text_place"], at[r["declared"]]): r["count"] for r in pairs if r["declared"] in at}
    known: dict[int, int] = {}
    for (lang, _), n in confusion.items():
        known[lang] = known.get(lang, 0) + n
    joined = scored.join(by("host"), "host", "left").join(by("suffix"), "suffix", "left")
    return joined.mapInArrow(
        partial(_fuse, languages=languages, confusion=confusion, known=known, corpus=corpus),
        "doc_id long, row_key string, declared string, lang string, text_lang string, posterior double, accepted boolean",
    )
