import collections
import hashlib
import random

import numpy as np
import pytest

from pitloom.llm import suffix_dedup
from pitloom.llm.suffix_dedup import permuted_prefixes, repeated, suffix_array


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(x[j : j + length] for x in raw for j in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, dtype=int)
        for j in range(len(x) - length + 1):
            if n[x[j : j + length]] > 1:
                gone[j] += 1
                gone[j + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        kept = bytes(np.frombuffer(x, dtype=np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_arrays():
    r = np.random.default_rng(4)
    cases = [r.integers(1, k + 1, n) for k in (1, 2, 3, 30, 2000) for n in (0, 1, 2, 5, 50, 800)]
    cases += [np.tile(r.integers(1, 4, 7), 90), np.repeat(r.integers(1, 5, 20), 30), np.array([2, 1] * 300), np.array([1] * 500 + [2] * 500)]
    for x in cases:
        t = np.append(x, 0)
        raw = t.tolist()
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert suffix_array(t).tolist() == want
        before, common = permuted_prefixes(t, np.array(want), 0)
        for a, b in zip(want, want[1:]):
            n = next(k for k in range(len(raw)) if raw[a + k] != raw[b + k])
            assert before[b] == a and common[b] == n


def test_repeated_stops_between_texts():
    texts = [b"abcabcab", b"xabc", b"", b"\x00\x00\x00\x01", b"\x00\x00\x00", b"zzzz"]
    begins, hit = repeated(texts, 3)
    at = lambda i: [j for j in range(len(texts[i])) if hit[begins[i] + j]]
    assert [at(i) for i in range(len(texts))] == [[0, 1, 2, 3, 4, 5], [1], [], [0], [0], [0, 1]]


@pytest.fixture(scope="module")
def crowd(spark):
    """One short line and one long passage in many texts that differ else, copies, one letter for long, and a text longer than a chunk."""
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    line, passage, near = some(35), some(90), some(300)
    texts = [some(r.randint(0, 120)) + line + some(r.randint(0, 120)) for _ in range(120)]
    texts += [some(r.randint(10, 60)) + passage + some(r.randint(10, 60)) for _ in range(60)]
    for _ in range(60):
        k = r.randrange(300)
        texts.append(near[:k] + r.choice("xyz") + near[k + 1 :])
    texts += ["a" * 500, "ab" * 300, "same " * 100, "x" + "a" * 39, some(900), "", None, line, "short"]
    texts += [texts[0], texts[300 % len(texts)], texts[5] + texts[6]]
    return texts


def test_suffix_dedup_matches_brute_force(spark, crowd, corpus, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    table = spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string")
    want = dict(enumerate(brute(crowd, 40)))
    assert 20 < sum(v[1] > 0 for v in want.values()) < len(crowd)
    for hot, shard in ((512, 1 << 20), (4, 2000)):
        monkeypatch.setattr(suffix_dedup, "LEVELS", (64, 1) if hot > 4 else (8, 1))
        assert found(suffix_dedup.suffix_dedup(table, length=40, hot=hot, shard_bytes=shard)) == want
    assert found(suffix_dedup.suffix_dedup(docs, length=60)) == dict(zip([i for i, _ in corpus], brute([t for _, t in corpus], 60), strict=True))


def test_suffix_dedup_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400), strict=True))
    assert sum(v[1] > 0 for v in want.values()) > 10
    assert found(suffix_dedup.suffix_dedup(docs)) == want
    assert found(suffix_dedup.suffix_dedup(docs, hot=2, shard_bytes=5000)) == want


def test_suffix_dedup_odd_rows(spark, odd, nothing):
    assert suffix_dedup.suffix_dedup(nothing).count() == 0
    rows = suffix_dedup.suffix_dedup(odd).collect()
    assert len(rows) == 8 and sum(r.doc_id is None for r in rows) == 2
    assert next(r for r in rows if r.doc_id == 6).n_removed == 5000
    twice = suffix_dedup.suffix_dedup(odd.union(odd).selectExpr("null as doc_id", "repeat(text, 500) as text")).collect()
    assert len(twice) == 16 and all(r.n_removed == r.n_bytes for r in twice)
