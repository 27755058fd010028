"""MinHash near-dedup with dart signatures.

A text is the multiset of its five-word shingles (a shorter text is one shingle); similarity is the weighted Jaccard
of the multisets, and texts of 0.8 or more are linked. The class of a document is its connected component.

* Signature (DartMinHash): every element owns a region, its weight wide and open towards higher ranks. Hashed darts
  fall into cells of the region as a Poisson process; of the darts of each coordinate the earliest counts. Cells are
  opened in order of rank until every coordinate has a dart, so a long text looks at a small part of its region.
* Bands of the signature are joined on their hash. Texts that are equal word by word are one node. In a bucket all
  members are verified against one hub, the member with the most company over all its buckets, never against each other.
* A pair that a hub does not settle is one where a member is in another component than the hub. These members are
  searched exactly: rare-first prefixes of their shingles meet those of all members of their buckets, with the size
  and position bounds that 0.8 implies as part of the join. What passes is verified like the rest.

Only rows of two or more near texts ever carry a text through an exchange. Nothing is capped.
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
from pitloom.llm.components import components
from pitloom.llm.words import U, counted, mix, seeded, shingles, word_hashes, words_of

THRESHOLD = 0.8
#: 24 bands of 5 coordinates: a pair at 0.8 shares a band with probability 0.9999, one at 0.3 with 0.06.
BANDS, ROWS = 24, 5
FIRST_CELL, CELL = 1 / 16, 0.5
#: Counters of the frequency sketch that orders shingles by rarity; any order is right, this one is quick.
SKETCH = 1 << 20
SIZE_STEP = 1.05


def _tails(mean: float) -> list[float]:
    """P(at least j darts), j = 1, 2, ... of a Poisson count."""
    term = total = float(np.exp(-mean))
    tails = []
    for j in range(1, 24):
        tails.append(1.0 - total)
        term *= mean / j
        total += term
        if 1.0 - total < 1e-18:
            break
    return tails


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: list[np.ndarray], weights: list[np.ndarray], k: int = BANDS * ROWS) -> np.ndarray:
    """(documents, k) signatures of weighted sets; two agree in a coordinate with the probability of their weighted Jaccard.
    Sets without weight get zeros."""
    docs = len(elements)
    signature = np.zeros(docs * k, dtype=np.uint64)
    filled = np.zeros(docs * k, dtype=bool)
    if not docs:
        return signature.reshape(0, k)
    sizes = [len(e) for e in elements]
    owner = np.repeat(np.arange(docs), sizes)
    element = np.concatenate(elements) if docs else np.zeros(0, dtype=np.uint64)
    weight = np.concatenate(weights).astype(np.float64)
    columns = np.ceil(weight).astype(np.int64)
    column = np.arange(columns.sum()) - np.repeat(np.cumsum(columns) - columns, columns)
    owner, width = np.repeat(owner, columns), np.repeat(weight, columns) - column
    unit = mix(np.repeat(element, columns) + mix(column.astype(np.uint64)))
    start, length, level = 0.0, FIRST_CELL, 0
    while len(unit):
        parts = max(1, round(length / CELL))
        cell = length / parts
        at = unit if parts == 1 else np.repeat(unit, parts)
        doc = owner if parts == 1 else np.repeat(owner, parts)
        wide = width if parts == 1 else np.repeat(width, parts)
        sub = np.zeros(len(at), dtype=np.int64) if parts == 1 else np.tile(np.arange(parts), len(unit))
        base = seeded(at + sub.astype(np.uint64) * U(0xD1342543DE82EF95), 101 + level)
        chance = _unit(base)
        found = []
        for j, tail in enumerate(_tails(cell)):
            hit = np.flatnonzero(chance < tail)
            if not len(hit):
                break
            dart = seeded(base[hit], 7 + j)
            if (wide[hit] < 1).any():  # the last column of an element may be narrower than one
                inside = _unit(seeded(dart, 3)) < wide[hit]
                hit, dart = hit[inside], dart[inside]
            found.append((doc[hit] * k + (dart % U(k)).astype(np.int64), start + cell * (sub[hit] + _unit(seeded(dart, 5))), dart))
        if found:
            slot, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
            new = ~filled[slot]
            slot, rank, dart = slot[new], rank[new], dart[new]
            order = np.lexsort((rank, slot))
            slot, dart = slot[order], dart[order]
            first = np.ones(len(slot), dtype=bool)
            first[1:] = slot[1:] != slot[:-1]
            signature[slot[first]], filled[slot[first]] = dart[first], True
            open_docs = ~filled.reshape(docs, k).all(axis=1)
            if not open_docs.all():
                keep = open_docs[owner]
                unit, owner, width = unit[keep], owner[keep], width[keep]
        start += length
        length = max(FIRST_CELL, start)
        level += 1
    return signature.reshape(docs, k)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One number for each band, its place included."""
    total = np.zeros((len(signature), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = signature.reshape(len(signature), BANDS, ROWS)
    for r in range(ROWS):
        total = mix(total * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return total


def _shingle_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return counted(shingles(word_hashes(words_of(text))))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two counted multisets; two empty ones are alike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, at = b.column("text").to_pylist(), 0
        while at < len(texts):
            nodes, elements, weights, size, begin = [], [], [], 0, at
            while at < len(texts) and size < 200_000:
                words = words_of(texts[at])
                nodes.append(hashlib.md5(b" ".join(words)).hexdigest())
                e, w = counted(shingles(word_hashes(words)))
                elements.append(e)
                weights.append(w)
                size += len(words) + 1
                at += 1
            keys = band_keys(dart_signatures(elements, weights)).view(np.int64)
            lists = [row if len(e) else [] for row, e in zip(keys.tolist(), elements, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).slice(begin, at - begin) for c in ("doc_id", "row_key")), pa.array(nodes, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "row_key", "node", "bands"],
            )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple] = {}
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
        out = []
        for x, y, s, t in zip(*cols, strict=True):
            if y not in held:
                if len(held) > 50:
                    held.clear()
                held[y] = _shingle_counts(t)
            if similarity(_shingle_counts(s), held[y]) >= THRESHOLD:
                out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.string()) for i in (0, 1)], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a string, b string")


def _units(text: str) -> np.ndarray:
    """The multiset as a set: the second and later occurrences of a shingle are elements of their own."""
    e, w = _shingle_counts(text)
    column = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
    return mix(np.repeat(e, w) + mix(column.astype(np.uint64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, dtype=np.int64)
    for b in batches:
        units = [_units(t) for t in b.column("text").to_pylist()]
        if units:
            total += np.bincount((np.concatenate(units) % U(SKETCH)).astype(np.int64), minlength=SKETCH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])


def _step(n: np.ndarray | int) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(SIZE_STEP) + 1e-9).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray, probe: bool) -> Iterator[pa.RecordBatch]:
    t = THRESHOLD
    for b in batches:
        out: list[tuple] = []
        for node, label, text in zip(*(b.column(c).to_pylist() for c in ("node", "label", "text")), strict=True):
            units = _units(text)
            n = len(units)
            if not n:
                continue
            place = np.arange(n - int(np.ceil(t * n - 1e-9)) + 1)
            units = units[np.lexsort((units, counts[(units % U(SKETCH)).astype(np.int64)]))][: len(place)]
            if probe:  # a partner of size m needs an overlap of t / (1 + t) * (n + m), and n - place are left
                high = np.minimum(n / t, (1 + t) / t * (n - place) - n) + 1e-6
                low = t * n - 1e-6
                fine = high >= low
                units, place, high = units[fine], place[fine], high[fine]
                first, last = _step(int(np.ceil(low))), _step(np.floor(high))
                reps = np.maximum(last - first + 1, 0)
                step = first + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                out.append((np.repeat(units, reps), step, np.full(reps.sum(), n), np.repeat(place, reps), [node] * int(reps.sum()), [label] * int(reps.sum())))
            else:
                out.append((units, np.full(len(place), _step(n)), np.full(len(place), n), place, [node] * len(place), [label] * len(place)))
        if out:
            cols = [np.concatenate([o[i] for o in out]) for i in range(4)]
            names = [pa.array([x for o in out for x in o[i]], pa.string()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0].view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols[1:]), *names], names=["unit", "step", "size", "place", "node", "label"]
            )


_PREFIX = "unit long, step long, size long, place long, node string, label string"


def _unsettled_pairs(members: DataFrame, hubs: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Pairs of members of one bucket and of different components that could still be near; None if every hub settles its bucket."""
    label = labels.select(F.col("node"), F.col("label"))
    rows = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hub_label = hubs.join(label.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub", "left")
    rows = rows.join(hub_label.select("bucket", F.coalesce("hub_label", "hub").alias("hub_label")), "bucket")
    loose = stored(rows.filter("label <> hub_label").select("bucket", "node", "label"), "loose")
    if loose.isEmpty():
        return None
    crowd = rows.join(loose.select("bucket").distinct(), "bucket", "left_semi").select("node", "label").distinct()
    crowd = stored(crowd.join(texts, "node"), "crowd")
    counts = np.zeros(SKETCH, dtype=np.int32)
    sums = crowd.select("text").mapInArrow(_sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SKETCH rows at most
    counts[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    probing = crowd.join(loose.select("node").distinct(), "node", "left_semi")
    left = probing.select("node", "label", "text").mapInArrow(partial(_prefixes, counts=counts, probe=True), _PREFIX)
    right = crowd.select("node", "label", "text").mapInArrow(partial(_prefixes, counts=counts, probe=False), _PREFIX)
    need = THRESHOLD / (1 + THRESHOLD)
    v, u = left.alias("v"), right.alias("u")
    bound = F.col("u.size") + F.col("v.size")
    fits = (
        (F.col("v.label") != F.col("u.label"))
        & (F.col("u.size") - F.col("u.place") >= need * bound - 1e-6)
        & (F.col("v.size") - F.col("v.place") >= need * bound - 1e-6)
        & (F.col("u.size") >= THRESHOLD * F.col("v.size") - 1e-6)
    )
    pairs = v.join(u, (F.col("v.unit") == F.col("u.unit")) & (F.col("v.step") == F.col("u.step")) & fits)
    return pairs.select(F.greatest("v.node", "u.node").alias("a"), F.least("v.node", "u.node").alias("b")).distinct()


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, row_key, class_id, class_size, node (MD5 of the words joined by one space), keeps.

    class_id is the smallest id of the class that is not null (null if it has none), class_size counts rows. Texts of
    equal words are always one class, so all texts without a word are one. `keeps` marks the rows of the document
    that stays: those that carry class_id and the class's kept node, or all if there is no id. Rows that repeat an id
    within a node are told alike. An empty table gives no rows; other columns are neither read nor returned.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(text).cast("string").alias("text"))
    signed = stored(base.mapInArrow(_sign, "doc_id long, row_key string, node string, bands array<long>"), "signatures")
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("n"), F.any_value("bands").alias("bands")), "nodes")
    slots = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    members = stored(slots.join(crowded, "bucket"), "members")
    score = members.groupBy("node").agg(F.sum("crowd").alias("company"))
    hubs = members.join(score, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("top")).select("bucket", F.col("top.node").alias("hub"))
    hubs = stored(hubs, "hubs")
    pairs = members.join(hubs, "bucket").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = score.select("node")
    first = base.select(F.md5(_joined_words(F.col("text"))).alias("node"), "text").join(near, "node", "left_semi")
    texts = stored(first.dropDuplicates(["node"]), "texts")
    links = stored(verified(pairs, texts), "verified")
    labels = components(links)
    more = _unsettled_pairs(members, hubs, labels, texts)
    if more is not None:
        extra = stored(verified(more, texts), "verified")
        if not extra.isEmpty():
            labels = components(links.union(extra))
    of = nodes.join(labels, "node", "left").select("node", "low_id", "n", F.coalesce("label", "node").alias("label"))
    classes = of.groupBy("label").agg(F.min("low_id").alias("class_id"), F.sum("n").alias("class_size"))
    of = of.join(classes, "label")
    kept_node = of.filter(F.col("low_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("node").alias("kept_node"))
    of = of.join(kept_node, "label").select("node", "class_id", "class_size", "kept_node")
    found = signed.select("doc_id", "row_key", "node").join(of, "node")
    keeps = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))
    return found.select("doc_id", "row_key", "class_id", "class_size", "node", keeps.alias("keeps"))


def _joined_words(text):
    """The words joined by one space, as the signatures' node names have them."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", ""), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")
