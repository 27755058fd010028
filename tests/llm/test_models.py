import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pitloom.llm import lattice_lm, mixing, piece_codec, topk_index
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


PARTS = ["a", "e", "the ", " ", "  ", "    ", "\n", "\t", "é", "日本", "𝔘", "▁", "in", "ing", "23", "{", "();", "\r\n", "\x00", "<s>", "<0x0A>", "😀", "aa", "==", "​", "ø"]


def test_codec_equals_the_library(library):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * (2 * k) for k in range(20)] + ["a" * k for k in range(40)] + ["-" * k for k in range(40)]
    codec = piece_codec.codec(piece_codec.default_model())
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == library.decode(ids)
    for _ in range(200):
        ids = [r.randrange(32000) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids)


def test_codec_digests(spark, docs, odd, nothing, library, sf_dir):
    for table in (docs, odd, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter()
        for i, t in table.select("doc_id", "text").collect():
            ids = library.encode(t or "")
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in piece_codec.encode_digests(table).collect()) == want
    assert piece_codec.encode_digests(nothing).count() == 0
    back = {r.doc_id: r.text for r in piece_codec.decode(piece_codec.encode(docs)).collect()}
    assert back == {r.doc_id: library.decode(library.encode(r.text or "")) for r in docs.collect()}


def brute_top(rows, k=5):
    out = set()
    for i, v in rows:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1)}
    return out


def test_top_k_matches_brute_force(spark, sf_dir):
    r = random.Random(6)
    rows = [(i, [float(np.float32(r.uniform(-2, 2))) for _ in range(5)]) for i in range(230)] + [(i, [0.5, -0.25, 1.0, 0.0, 3.0]) for i in range(230, 260)]
    rows += [(300, [1.0, 2.0]), (350, []), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (450, [1000.0] * 5), (None, [0.1] * 5)]
    rows += [(50, rows[50][1])]
    got = topk_index.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, block_rows=40, query_group=3)
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    assert {tuple(x) for x in got.collect()} == brute_top(list(fine.items()))
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {tuple(x) for x in topk_index.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    assert got == brute_top([(x.vec_id, [math.floor(256 * y) for y in x.embedding]) for x in table.collect()])
    assert topk_index.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mixing_meets_its_targets(spark, docs, odd, nothing):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "w " * (1 + i % 50)) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(table, target_entropy=0.97, max_repeats=None).collect()
    tokens, drawn = Counter(), Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
        drawn[r.source] += r.n_tokens * r.copies
    total = sum(tokens.values())
    weights = {r.source: r.weight for r in got}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert abs(entropy - 0.97 * math.log(len(weights))) < 1e-5
    power = {s: (n / total) ** got[0].exponent for s, n in tokens.items()}
    assert all(abs(weights[s] - power[s] / sum(power.values())) < 1e-8 for s in weights)
    assert all(weights[s] * total - 60 <= drawn[s] <= weights[s] * total for s in weights)
    limited = mixing.mix(table, target_entropy=None, max_repeats=1.5).select("source", "weight").distinct().collect()
    assert abs(max(r.weight * total / tokens[r.source] for r in limited) - 1.5) < 1e-5
    assert mixing.mix(nothing).count() == 0 and mixing.mix(odd).count() == 8 and mixing.mix(docs).count() == docs.count()


def test_mixing_is_native_and_realised_whole(spark, docs):
    mixed = mixing.mix(docs)
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    out = mixing.realise(docs, mixed)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in mixed.collect() if r.copies})


def brute_base(rows):
    count, tokens = Counter(), {}
    for i, t in rows:
        words = (t or "").encode().lower().split() + [b""]
        tokens[i] = words
        if zlib.crc32(str(i).encode()) % 10:
            count.update(words)
    n, v = sum(count.values()), len(count)
    return {
        i: (zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in tokens.items()
    }


@pytest.mark.parametrize("head", [5, 200_000])
def test_lattice_scores(docs, corpus, head):
    got = {r.doc_id: r for r in lattice_lm.score_documents(docs, head=head).collect()}
    for i, (out, n, known, total, score) in brute_base(corpus).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert abs(r.base_score - score) < 1e-6 and r.score < 0


@pytest.mark.parametrize("head", [5, 200_000])
def test_lattice_document_scores(docs, corpus, head):
    """Whole documents from the definitions: one round of expectation over all training words, then each token's sum over its segmentations."""
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, head=head).collect()}
    lat = lattice_lm.lattice(piece_codec.default_model())
    tokens = {i: (t or "").encode().lower().split() for i, t in corpus}
    first, uses = np.log(np.maximum(lat.guess, 1e-300)).tolist(), np.zeros(lat.size)
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            uses[lat.end] += 1
            for w in words:
                lat.expect(w, 1, first, uses)
    log_p = np.log(np.maximum((uses + lattice_lm.PRIOR * lat.guess) / (uses.sum() + lattice_lm.PRIOR), 1e-300)).tolist()
    for i, words in tokens.items():
        want = (sum(lat.log_probability(w, log_p) for w in words) + log_p[lat.end]) / math.log(10)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want))


def segmentations(text, pieces):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield (text[:n], *rest)


def test_lattice_sums_all_segmentations():
    lat = lattice_lm.lattice(piece_codec.default_model())
    log_p = np.log(np.maximum(lat.guess, 1e-300)).tolist()
    codec = lat.codec
    reachable = {p for p, i in codec.ids.items() if codec.split(i) is not None}
    for word in ("the", "garden", "zzqx", "naïve", "12,000"):
        ways = [math.exp(sum(log_p[codec.ids[p]] for p in s)) for s in segmentations("▁" + word, reachable)]
        assert abs(lat.log_probability(word.encode(), log_p) - math.log(sum(ways))) < 1e-9
        uses = np.zeros(lat.size)
        lat.expect(word.encode(), 3, log_p, uses)
        want = Counter()
        for s, p in zip(segmentations("▁" + word, reachable), ways, strict=True):
            for x in s:
                want[codec.ids[x]] += 3 * p / sum(ways)
        assert all(abs(uses[i] - want[i]) < 1e-9 for i in range(lat.size))
    spelt = sum(log_p[codec.byte_ids[b]] for b in "𝔘".encode())
    assert abs(lat.log_probability("𝔘".encode(), log_p) - log_p[codec.ids["▁"]] - spelt) < 1e-9


def test_lattice_learns(spark, odd, nothing, sf_dir):
    """Held-out text is likelier under the trained weights than under the first guess."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trained = lattice_lm.score_documents(docs).filter("held_out").agg(F.sum("score")).first()[0]
    lat = lattice_lm.lattice(piece_codec.default_model())
    log_p = np.log(np.maximum(lat.guess, 1e-300)).tolist()
    first = 0.0
    for r in docs.filter(lattice_lm.held_out(F.col("doc_id"))).collect():
        for w, n in Counter(lattice_lm.tokens_of(r.text)).items():
            first += n * lat.log_probability(w, log_p) / math.log(10)
    assert trained > 0.95 * first
    assert lattice_lm.score_documents(nothing).count() == 0 and lattice_lm.score_documents(odd).count() == 8
