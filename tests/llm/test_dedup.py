import collections
import hashlib
import random
import re

import numpy as np
import pytest

from pitloom.llm import exact_dedup, near_dedup, substring_dedup
from pitloom.llm.common import keep_rows
from pitloom.llm.components import components
from pitloom.llm.words import U, mix


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_matches_brute_force(docs, corpus):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups[squeezed(t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == want


def test_exact_dedup_odd_rows(odd, nothing):
    rows = exact_dedup.exact_dedup(odd).collect()
    assert len(rows) == 8
    six = [r for r in rows if r.group_size == 4]
    assert {r.keep_id for r in six} == {3} and sorted(str(r.doc_id) for r in six if r.kept) == ["3", "3"]
    assert exact_dedup.exact_dedup(nothing).count() == 0
    kept = keep_rows(odd, exact_dedup.exact_dedup(odd, with_row_key=True).filter("kept"))
    assert kept.count() == 4 and kept.columns == odd.columns


def test_trie_spills_subtrees_and_keeps_every_text():
    r = random.Random(3)
    keys = [b"".join(r.choice([b"common prefix ", b"x", b"yy", b"\xc3\xa9"]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    trie, want = exact_dedup.PatriciaTrie(memory=40_000), {}
    for i, k in enumerate(keys):
        trie.insert(k, (i, 1, len(k)))
        low, n = want.get(k, (i, 0))
        want[k] = (min(low, i), n + 1)
    assert trie.spills > 2
    assert {k: v[:2] for k, v in trie.items()} == want


def brute_substrings(rows, length=50):
    low = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for j in range(len(w) - length + 1):
            k = tuple(w[j : j + length])
            low[k] = min(low.get(k, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - length + 1):
            if low[tuple(w[j : j + length])] < i:
                gone.update(range(j, j + length))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return out


def test_substring_dedup_matches_brute_force(docs, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    want = brute_substrings(corpus)
    assert got == want and sum(v[1] for v in want.values()) > 500


def test_substring_dedup_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])


def test_substring_dedup_odd_rows(spark, odd, nothing):
    assert substring_dedup.substring_dedup(nothing).count() == 0
    assert substring_dedup.substring_dedup(odd).count() == 8
    long = " ".join(map(str, range(60)))
    rows = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long + " tail")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(rows).collect())
    assert got == [(60, 0), (60, 0), (60, 0), (61, 60)]


def brute_classes(rows):
    bags = {}
    for i, t in rows:
        w = (t or "").encode().split()
        k = min(5, len(w))
        bags[i] = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else collections.Counter()
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b:
                both, total = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
                if total == 0 or both / total >= 0.8:
                    parent[root(b)] = root(a)
    low = {}
    for i in bags:
        low[root(i)] = min(low.get(root(i), i), i)
    return {i: low[root(i)] for i in bags}


def test_near_dedup_matches_brute_force(docs, corpus):
    rows = near_dedup.near_dedup(docs).collect()
    want = brute_classes(corpus)
    assert {r.doc_id: r.class_id for r in rows} == want
    size = collections.Counter(want.values())
    assert all(r.class_size == size[r.class_id] and r.keeps == (r.doc_id == r.class_id) for r in rows)


def test_near_dedup_finds_what_hubs_leave_open(spark):
    """Chains of near copies: each is near the next one, but not the hub."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows, t = [], base[:]
    for i in range(24):
        rows.append((i, " ".join(t)))
        t = t[:]
        t[(i * 17) % 115] = f"n{i}"
        t[(i * 17 + 1) % 115] = f"m{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_dedup(docs).collect()}
    assert got == brute_classes(rows)


def test_near_dedup_odd_rows(odd, nothing):
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == 8 and near_dedup.near_dedup(nothing).count() == 0
    assert {r.class_id for r in rows if r.class_size == 4} == {3}
    assert keep_rows(odd, near_dedup.near_dedup(odd).filter("keeps")).count() == 4


@pytest.mark.parametrize("weights", ["whole", "real"])
def test_dart_signatures_estimate_weighted_jaccard(weights):
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate([a[:150], r.integers(0, 2**63, 50).astype(np.uint64)])
    wa, wb = (r.integers(1, 5, 200), r.integers(1, 5, 200)) if weights == "whole" else (r.uniform(0.2, 3, 200), r.uniform(0.2, 3, 200))
    elements, bags = [], []
    for _ in range(150):
        s = U(r.integers(0, 2**62))
        elements += [mix(a + s), mix(b + s)]
        bags += [wa, wb]
    sig = near_dedup.dart_signatures(elements, bags)
    common = np.minimum(wa[:150], wb[:150]).sum()
    assert abs((sig[0::2] == sig[1::2]).mean() - common / (wa.sum() + wb.sum() - common)) < 0.015
    assert (near_dedup.dart_signatures(elements[:1], bags[:1])[0] == sig[0]).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 60)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(21)} | {40: 40, 50: 40}
