import collections
import random
import re
import zlib

from pitloom.llm import spelling_variants
from pitloom.llm.spelling_variants import group_variants


def brute(rows):
    """Each word's edits of every kind are looked up in the dictionary of all words."""
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1)}
        near[w] = [x for x in edits if x != w and x in n]
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def found(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def variants():
    """Texts of words with slips, doubled letters, accents, capitals and one very long word."""
    r = random.Random(5)
    base = ["garden", "gardens", "aabbcc", "aaaaa", "aaaaaa", "königin", "ÀÉîÿu", "market", "marked", "x" * 80, "x" * 79, "x" * 81, "y" + "x" * 79, "letter"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.4)), len(base) - 1)]
            if r.random() < 0.3:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aexé") + w[k:], w[:k] + r.choice("aexé") + w[k + 1 :], w.upper() if w.isascii() else w])
            words.append(w)
        rows.append((i, r.choice([" ", ", ", "-", "日", "Ā"]).join(words)))
    rows += [(500 + i, "chains " + "chainz " * (i < 10) + "chaizz" * (i < 4)) for i in range(30)]  # a chain of two steps
    return rows + [(None, "garden gardn gardn gardn"), (400, ""), (401, None), (400, "repeat repeat repeat"), (400, "repeat repeat repeat")]


def test_variants_match_brute_force(spark):
    rows = variants()
    want = brute(rows)
    assert sum(x[1] is not None for x in want) > 30 and any(x[1] != x[2] and x[1] for x in want)
    table = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert found(group_variants(table)) == want
    assert found(group_variants(table, shard_words=20, filter_bytes=200)) == want  # many shards, many rounds
    assert found(group_variants(table, shard_words=20, filter_bytes=200, bits=1)) == want  # filters that let most pass


def test_variants_tables(spark, sf_dir, docs, corpus, odd, nothing):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(group_variants(table)) == brute([(r.doc_id, r.text) for r in table.collect()])
    assert found(group_variants(docs)) == brute(corpus)
    assert found(group_variants(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert group_variants(nothing).count() == 0


def test_filters_let_few_pass():
    import numpy as np

    r = random.Random(1)
    words = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(20000)]
    words = list(dict.fromkeys(words))
    hashes = [x for _, letters in spelling_variants.by_length(words) for x in spelling_variants.mix(spelling_variants.part(np.arange(8), letters).sum(axis=1, dtype=np.uint64)).tolist()]
    import pyarrow as pa

    blocks = {8: -(-len(words) * spelling_variants.BITS // 256)}
    n = len(words)
    rows = pa.table({"length": pa.array([8] * n, pa.int32()), "slice": pa.array([0] * n, pa.int32()), "hash": pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), "letters": pa.array([b"abcdefghij"] + [b""] * (n - 1), pa.binary())})
    filters = spelling_variants.Filters({8: 1}, blocks, spelling_variants._build(rows, blocks).to_pylist())
    own = np.array(hashes, dtype=np.uint64)
    assert len(filters.passing(8, own)) == n
    assert len(filters.passing(8, spelling_variants.mix(own + np.uint64(99)))) < 0.01 * n
