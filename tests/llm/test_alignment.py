import collections
import hashlib

from pitloom.llm import token_alignment
from pitloom.llm.token_alignment import default_tokenizers, tokenizer_pair

ODD = ["▁a b", "x", " ", "  a", "a  b", "<s> </s>", "<|endoftext|> a", "\x00 b", "é 日本 😀 \n\n x", "tab\t x", "a \n b", "it's we'll 'x", "x" * 3000, " " * 2000]
ODD += ["ab " * 1500 + "  end  ", "\ufeff a", "a\u200b b", "ﬁ ｱ", "a\r\nb", "A\u2028B", "1 2 3 45", "! ? a !b", "", None]


def brute(rows):
    """Every A-B pair of tokens is tested in turn; counts are then taken over all rows."""
    p = tokenizer_pair(*default_tokenizers())
    parts = []
    for i, text in rows:
        a, b = p.a.encode(" " + (text or ""), add_special_tokens=False).ids, p.b.encode(text or "")
        sides = []
        for ids, names in ((a, p.bytes_a), (b, p.bytes_b)):
            ends, at = [], 0
            for t in ids:
                ends.append((at, at + len(names[t])))
                at += len(names[t])
            sides.append((ids, ends, b"".join(names[t] for t in ids)))
        if not text or any(s[2] != (" " + text).encode() for s in sides):
            parts.append((i, [], [], 0, [], ""))
            continue
        (_, ends_a, _), (_, ends_b, _) = sides
        links, first = [], 0
        for x, (s, e) in zip(a, ends_a):
            while ends_b[first][1] <= s:
                first += 1
            k = first
            while k < len(b) and ends_b[k][0] < e:
                links.append((x, b[k]))
                k += 1
        common, groups, ia, ib = sorted({e for _, e in ends_a} & {e for _, e in ends_b}), [], 0, 0
        for c in common:
            ja = next(j for j in range(ia, len(a)) if ends_a[j][1] == c) + 1
            jb = next(j for j in range(ib, len(b)) if ends_b[j][1] == c) + 1
            groups.append(",".join(map(str, a[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
            ia, ib = ja, jb
        parts.append((i, a, b, len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = collections.Counter(pair for x in parts for pair in set(x[4]))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(
        (i, len(a), len(b), g, len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), digest) for i, a, b, g, links, digest in parts
    )


def found(df):
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_matches_brute_force(spark, docs, corpus):
    rows = corpus + [(1000 + i, t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for head in (token_alignment.HEAD, 300, 0):  # all pairs at every task, some joined, all joined
        assert found(token_alignment.align_tokenizers(table, head=head)) == want
    assert found(token_alignment.align_tokenizers(docs, head=40)) == brute(corpus)


def test_alignment_without_ranks(spark, corpus):
    table = spark.createDataFrame(corpus, "doc_id long, text string")
    assert found(token_alignment.align_tokenizers(table, tokenizers=default_tokenizers()[:2])) == brute(corpus)


def test_alignment_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert found(token_alignment.align_tokenizers(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_odd_rows(spark, odd, nothing):
    assert token_alignment.align_tokenizers(nothing).count() == 0
    rows = token_alignment.align_tokenizers(odd).collect()
    assert len(rows) == 8 and sum(r.doc_id is None for r in rows) == 2
    same = [r for r in rows if r.n_a and r.groups_sha256 == next(x.groups_sha256 for x in rows if x.doc_id is None)]
    assert len(same) == 4 and len({(r.n_best, r.count_sum) for r in same}) == 1
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in rows if r.doc_id == 5] == [(0, 0, "")] * 2
