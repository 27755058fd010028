"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

1. Pattern matches (e-mail, IPv4, card, phone) are the base and the seeds.
2. Every token that could be an identifier of a kind but is none of its base matches is an instance; the words next
   to seeds and instances are lexical patterns (kind, side, word). Edges tie patterns to instances, each counted once
   for a different identifier, so copies of a document prove nothing.
3. Scores are iterated on the graph. A pattern's confidence is the sum of its identifiers' scores over the number of its scored
   identifiers and of the other different tokens next to its word on that side in the corpus; identifiers of its kind
   that have no score yet are unknown and count for neither. An instance's score is the noisy-or of the patterns that
   it occurs with; seeds keep score 1. So a pattern that meets discovered identifiers only can be trusted in a later round, and
   discovers others. Rounds go on until no pattern is trusted anew; a trusted pattern stays so, which bounds them.
4. Instances whose score reaches the threshold are reported as further spans of their kind.

A pattern is trusted only if there are no more other neighbours than identifiers. So the neighbours of words are first counted
roughly (one sketch for each word and task), the words that have surely too many go, and the rest are counted exactly. The words
of interest reach the scan as a bitmap of fixed size, so most of a text never becomes a row.

Matches are located by splitting the text at them; possessive quantifiers and look-behinds make the expressions linear, and
running sums go in blocks, so a text of very many matches costs little more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: The published patterns, with possessive quantifiers and starts that cannot lie inside a run that failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that could be an identifier of a kind beyond its base pattern.
TYPES = {
    "email": r"[^\s@]+(?:@|\[at\]|\(at\))[^\s@]+",
    "ip": r"[0-9]+[.:][0-9]+[.:][0-9]+[.:][0-9.:]+",
    "card": r"[0-9][0-9-]{11,22}[0-9]",
    "phone": r"\(?[0-9][0-9().-]{6,16}[0-9]",
}
#: A token of 6 characters or more that holds a digit or an at sign, also a spelt one.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*?(?:[0-9@]|[\[(]at[\])]))[^\x20\x09-\x0D]{6,}+"
_WORD = r"[^\x20\x09-\x0D]"
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE = 3, 0.5, 0.6
#: Numbers of 64 bits in the bitmap of words, and the relative error of the rough counts; a word goes if it has MARGIN times too many neighbours, ten such errors.
SLOTS, ERROR, MARGIN = 1 << 14, 0.1, 2
_ENDS = ",;.!?"

_FOUND = "struct<start: long, end: long, value: string, before: string, after: string>"


def _let(value: Column, body) -> Column:
    """`body` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    doubled = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _let(doubled(i), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    return F.length(digits).between(9, 15)


def running(values: Column, combine) -> Column:
    """The running `combine` of an array of numbers. Appending copies an array, so it is done within blocks of the square root of the size, and over blocks."""

    def scan(values: Column) -> Column:
        return _let(values, lambda v: F.aggregate(F.slice(v, 2, F.size(v)), F.array(F.get(v, F.lit(0))), lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x))))

    def of(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        inner = _let(step, lambda n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1), lambda b: scan(F.slice(v, b * n + 1, n))))
        join = lambda blocks, heads: F.transform(blocks, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda y: combine(F.get(heads, i - 1), y))))
        whole = _let(inner, lambda blocks: _let(scan(F.transform(blocks, lambda x: F.element_at(x, -1))), lambda heads: F.flatten(join(blocks, heads))))
        return F.when(F.size(v) > 0, whole).otherwise(v)

    return _let(values, of)


def located(text: Column, pattern: str, keep) -> Column:
    """The matches of `pattern` that `keep` holds for, with positions in code points and the words next to them ("" where there is none before another match)."""
    last = lambda gap: F.regexp_extract(gap, rf"(?<!{_WORD})({_WORD}++)[\x20\x09-\x0D]*+\z", 1)
    first = lambda gap: F.regexp_extract(gap, rf"\A[\x20\x09-\x0D]*+({_WORD}++)", 1)

    def of(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            ahead = lambda i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0))
            starts = running(F.transform(matches, lambda m, i: ahead(i).cast("long")), lambda a, b: a + b)
            one = lambda at, m, i: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"))
            found = _let(starts, lambda s: F.transform(matches, lambda m, i: one(F.get(s, i), m, i)))
            found = F.filter(found, lambda x: keep(x["value"]))
            return F.transform(found, lambda x: F.struct(x["start"], x["end"], x["value"], last(x["before"]).alias("before"), first(x["after"]).alias("after")))

        return F.when(F.size(matches) > 0, _let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(f"array<{_FOUND}>"))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def untouched(tokens: Column, spans: Column) -> Column:
    """The tokens that no span overlaps. Both are put in one order: how far spans reached before a token, and where the next one begins, decide."""
    far = 1 << 62
    event = lambda x, kind: F.struct(x["start"].alias("at"), F.lit(kind).alias("kind"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform(spans, lambda s: event(s, 0)), F.transform(tokens, lambda t: event(t, 1))))

    def of(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: F.when(e["kind"] == 0, e["end"]).otherwise(F.lit(-1))), F.greatest)
        ahead = F.reverse(running(F.transform(F.reverse(events), lambda e: F.when(e["kind"] == 0, -e["at"]).otherwise(F.lit(-far))), F.greatest))
        free = lambda e, i, r, n: F.struct(e["kind"], ((F.get(r, i) <= e["at"]) & (-F.get(n, i) >= e["end"])).alias("free"))
        flags = _let(reach, lambda r: _let(ahead, lambda n: F.filter(F.transform(events, lambda e, i: free(e, i, r, n)), lambda x: x["kind"] == 1)))
        return _let(flags, lambda f: F.filter(tokens, lambda t, i: F.get(f, i)["free"]))

    return F.when((F.size(spans) == 0) | (F.size(tokens) == 0), tokens).otherwise(_let(both, of))


def _with_hint(kind: str, text: Column, found: Column) -> Column:
    """Texts without the sign that a kind cannot do without are not searched."""
    sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    return F.when(F.contains(text, F.lit(sign)), found).otherwise(F.array().cast(f"array<{_FOUND}>")) if sign else found


def base_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, an array of base matches for each kind and the instances: (kind, match) of tokens that no base match of the document touches."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    t = F.col("text")
    found = base.withColumns({k: _with_hint(k, t, located(t, PATTERNS[k], lambda v, k=k: passes(k, v))) for k in KINDS})
    like = lambda v: v.rlike("^(?:" + "|".join(TYPES.values()) + ")[,;.!?]*$")
    found = found.withColumn("tokens", located(t, TOKEN, like)).drop("text")
    free = _let(F.concat(*(F.col(k) for k in KINDS)), lambda spans: untouched(F.col("tokens"), spans))
    return found.withColumn("tokens", free).withColumn("row", F.monotonically_increasing_id())


def _clean(value: Column) -> Column:
    return F.rtrim(value, F.lit(_ENDS))


def _neighbours(found: Column, kind: Column) -> Column:
    """(kind, value, side, word) of the words next to a match."""
    side = lambda name, word: F.struct(kind.alias("kind"), F.lower(_clean(found["value"])).alias("value"), F.lit(name).alias("side"), F.lower(word).alias("word"))
    return F.array(side("before", found["before"]), side("after", found["after"]))


def _edges(matches: DataFrame) -> DataFrame:
    """kind, value, side, word, seed: each edge once."""
    near = lambda k: F.transform(F.col(k), lambda x: _neighbours(x, F.lit(k)))
    seeds = F.flatten(F.concat(*(near(k) for k in KINDS)))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("type")) for k, p in TYPES.items()))
    fits = lambda x: F.transform(
        F.filter(kinds, lambda k: F.rlike(_clean(x["value"]), F.concat(F.lit("^(?:"), k["type"], F.lit(")$")))), lambda k: _neighbours(x, k["kind"])
    )
    others = F.flatten(F.flatten(F.transform("tokens", fits)))
    both = matches.select(F.explode(F.concat(F.transform(seeds, lambda e: F.struct(e.alias("e"), F.lit(True).alias("seed"))), F.transform(others, lambda e: F.struct(e.alias("e"), F.lit(False).alias("seed"))))).alias("x"))
    rows = both.select("x.e.kind", "x.e.value", "x.e.side", "x.e.word", "x.seed").filter("word <> ''")
    return rows.groupBy("kind", "value", "side", "word").agg(F.max("seed").alias("seed"))


def _bits(asked: DataFrame) -> list[int]:
    """A bitmap of the (side, word) of `asked`; SLOTS numbers whatever their number."""
    h = F.xxhash64("side", "word")
    rows = asked.groupBy(F.pmod(F.shiftrightunsigned(h, 6), F.lit(SLOTS)).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(xxhash64(side, word) & 63 as int)))").alias("bits"))
    found = [0] * SLOTS
    for slot, bits in rows.collect():  # SLOTS rows at most
        found[slot] = bits
    return found


def neighbours(texts: DataFrame, bits: list[int]) -> DataFrame:
    """side, word, token (hashed): the tokens behind a word (side "before") and in front of it ("after"), for the words in the bitmap. `texts` has text."""
    held = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to one constant
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def in_bitmap(side: str, word: Column) -> Column:
        return _let(F.xxhash64(F.lit(side), word), lambda h: F.getbit(F.get(held, F.pmod(F.shiftrightunsigned(h, 6), F.lit(SLOTS)).cast("int")), h.bitwiseAND(63).cast("int")) == 1)

    def beside(w: Column, side: str, step: int) -> Column:
        rows = F.transform(w, lambda x, i: F.struct(F.lit(side).alias("side"), x.alias("word"), F.get(w, i + step).alias("token")))
        return F.filter(rows, lambda r: r["token"].isNotNull() & in_bitmap(side, r["word"]))

    rows = texts.select(F.inline(_let(words, lambda w: F.concat(beside(w, "before", 1), beside(w, "after", -1)))))
    return rows.select("side", "word", F.xxhash64(_clean(F.col("token"))).alias("token"))


def pattern_table(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """kind, side, word, others: the patterns that could be trusted, with the number of different neighbours that are no identifiers of the kind."""
    used = edges.groupBy("kind", "side", "word").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= LEAST_SUPPORT)
    parts = F.split("value", r"[\x20\x09-\x0D]+")
    token = F.when(F.col("side") == "before", F.get(parts, F.lit(0))).otherwise(F.element_at(parts, -1))
    own = edges.groupBy("side", "word").agg(F.count_distinct("value").alias("values"), F.count_distinct(token).alias("tokens"))
    used = stored(used.join(own, ["side", "word"]), "pii-patterns")
    most = stored(used.groupBy("side", "word").agg((F.max("met") + F.max("tokens")).alias("most")), "pii-asked")
    rough = neighbours(texts, _bits(most)).groupBy("side", "word").agg(F.approx_count_distinct("token", ERROR).alias("n"))
    few = stored(most.join(rough, ["side", "word"]).filter(F.col("n") <= MARGIN * F.col("most") + 16).select("side", "word"), "pii-few")
    exact = neighbours(texts, _bits(few)).distinct().join(few, ["side", "word"], "left_semi").groupBy("side", "word").agg(F.count(F.lit(1)).alias("n"))
    others = F.greatest(F.col("n") - F.col("tokens"), F.lit(0)) + F.col("values") - F.col("met")
    patterns = used.join(exact, ["side", "word"]).withColumn("others", others).filter(F.col("others") <= F.col("met"))
    return stored(patterns.select("kind", "side", "word", "others"), "pii-counted")


def instance_scores(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """kind, value, score of the instances that are no seeds and that a trusted pattern meets. `texts` has text.

    A pattern needs the weight of LEAST_SUPPORT identifiers, and LEAST_CONFIDENCE of all that counts. The weight is at most the
    number of scored identifiers, so one with more other neighbours than identifiers is never trusted.
    """
    edges = stored(_edges(matches), "pii-found")
    edges = stored(edges.join(pattern_table(edges, texts), ["kind", "side", "word"]), "pii-edges")
    scores, before = edges.select("kind", "value", F.lit(0.0).alias("score")).limit(0), 0
    while True:
        scored = edges.join(scores, ["kind", "value"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        support = scored.groupBy("kind", "side", "word", "others").agg(F.sum("score").alias("weight"), F.count_if(F.col("score") > 0).alias("known"))
        confidence = F.least(F.lit(0.999), F.col("weight") / (F.col("others") + F.col("known")))
        trusted = support.filter(F.col("weight") >= LEAST_SUPPORT).withColumn("confidence", confidence).filter(F.col("confidence") >= LEAST_CONFIDENCE)
        trusted = stored(trusted.select("kind", "side", "word", "confidence"), "pii-trusted")
        met = edges.filter("not seed").join(trusted, ["kind", "side", "word"])
        scores = stored(met.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score")), "pii-scores")
        n = trusted.count()
        if n == before:
            return scores
        before = n


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans.

    Positions are code points, end exclusive; spans are ordered by kind, then start. The counts are those of the base
    matches, which the added spans never change or touch. A null text is empty and has no span; a null id stays null;
    repeated rows are answered each; an empty table gives no rows; other columns are neither read nor returned.
    """
    matches = stored(base_matches(docs, doc_id, text), "pii-matches")
    scores = instance_scores(matches, docs.select(F.col(text).cast("string").alias("text"))).filter(F.col("score") >= LEAST_SCORE)
    clean = lambda x: _clean(x["value"])
    token = matches.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t"))
    token = token.select("row", F.lower(clean(F.col("t"))).alias("value"), F.col("t.start").alias("start"), (F.col("t.start") + F.length(clean(F.col("t")))).alias("end"))
    hits = token.join(scores.select("kind", "value"), "value")
    place = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int")
    hits = hits.groupBy("row").agg(F.collect_set(F.struct(place.alias("place"), "start", "end")).alias("added"))
    rows = matches.join(hits, "row", "left")
    ranges = lambda i, k: F.transform(F.col(k), lambda x: F.struct(F.lit(i).alias("place"), x["start"].alias("start"), x["end"].alias("end")))
    base = F.concat(*(ranges(i, k) for i, k in enumerate(KINDS, 1)))
    kind = lambda s: F.element_at(F.lit(list(KINDS)), s["place"])
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    added = F.coalesce("added", F.array().cast("array<struct<place: int, start: long, end: long>>"))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(shown(base), 256).alias("base_sha256"),
        F.size(added).cast("long").alias("n_added"),
        shown(F.concat(base, added)).alias("spans"),
    )
