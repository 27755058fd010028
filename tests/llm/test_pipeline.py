"""The pipeline against a brute-force version, and the queries against their SQL."""

import hashlib
import os
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from pitloom.llm import mixing, piece_codec  # noqa: E402
from tests.llm.test_dedup import brute_classes, squeezed  # noqa: E402


def test_run_matches_brute_force(spark, sf_dir):
    import sentencepiece

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]  # every lettered document here is in a modelled language
    seen = {}
    for i, t in sorted(rows):
        seen.setdefault(squeezed(t), (i, t))
    classes = brute_classes(sorted(seen.values()))
    left = [(i, t) for i, t in seen.values() if classes[i] == i]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"doc_id in ({','.join(str(i) for i, _ in left)})")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}  # mixing has SQL of its own, checked below
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    want = Counter()
    for i, t in left:
        ids = sp.encode(t)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += copies[i]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == +want


def test_stages(spark, odd, nothing):
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, "").columns == odd.columns
        assert stage(spark, nothing, "").count() == 0


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_exact_top_k", "op7_source_mixing"])
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    res = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in res.description]
    assert sorted(order) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*order).collect())) == Counter(map(tuple, res.fetchall()))


def test_all_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11))
