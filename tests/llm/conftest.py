import random
import string

import pytest

WORDS = "the of and report value market engine river stone paper light signal winter garden method result across under between report".split()


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, odd white space, an empty and a null one: (id, text)."""
    r = random.Random(7)
    word = lambda: r.choice(WORDS) if r.random() < 0.5 else "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(70)
    rows = []
    for i in range(60):
        kind = i % 6
        if kind == 0 or not rows:
            t = text(r.randint(1, 300))
        elif kind == 1:
            t = r.choice([x for x in rows if x])[:]
        elif kind == 2:
            t = r.choice([x for x in rows if x])[:]
            t[r.randrange(len(t))] = word()
        elif kind == 3:
            t = text(20) + passage[r.randrange(3) :] + text(15)
        elif kind == 4:
            t = ["again"] * r.randint(2, 90)
        else:
            t = text(r.randint(3, 9))
        rows.append(t)
    texts = ["".join(w + r.choice([" ", " ", " ", "  ", "\n", "\t"]) for w in t).strip() for t in rows]
    texts += ["", "   ", "  not a space", "éñß 日本 😀 mixed"]
    return list(enumerate(texts)) + [(len(texts), None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns that clash with names that the operators use."""
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 3}", i, "x", True) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep_id long, row_key string, kept boolean")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows and ids."""
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (3, "other text of one id"), (5, None), (5, None), (6, "x" * 5000)]
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
