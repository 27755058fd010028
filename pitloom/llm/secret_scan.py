"""Secret scan by patterns and dictionary-primed Zstandard novelty.

Pattern spans (assignments, access keys, long hex runs) are the base. Other strings near a sensitive word are candidates:
their novelty is the number of bytes that they add to the compressed surrounding text, with a compressor primed with
the identifiers most frequent around candidates and secrets of the whole corpus. Strings that hardly compress are
reported as kind "novel". The text is read once; what is kept of a document is its spans and candidates with their surroundings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import stored

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is found whole, so this equals all runs of which shorter ones are dropped
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what follows sensitive, besides those of the patterns.
SENSITIVE = ("credential", "authorization", "bearer", "private", "passphrase", "signature", "access", "secret", "token", "password", "passwd", "apikey", "api_key", "pwd")
#: A name with a sensitive word; what may stand between it and a string (any separators, up to two words); the string.
NAME = re.compile("(?ia:" + "|".join(SENSITIVE) + r")[A-Za-z0-9_]*+")
BETWEEN = tuple(re.compile(r"[^A-Za-z0-9]++" + r"[A-Za-z]++[^A-Za-z0-9]++" * n + r"(?=[A-Za-z0-9])") for n in range(3))
RUN = re.compile(r"[A-Za-z0-9+/_=-]*+")
#: A string that is itself an assignment to a sensitive name: only its value counts, which that name finds.
ASSIGNED = re.compile(r"[A-Za-z0-9_-]*?" + NAME.pattern.removesuffix("*+") + "*=")
#: Length from which a string is measured, and from which one is that mixes letters and digits (shorter words that no dictionary
#: holds would be as novel as keys); characters in which a name of its own is sought.
LEAST_LENGTH, LEAST_MIXED, LONGEST_NAME = 16, 8, 256
MIXED = re.compile(r"(?=[^0-9]*[0-9])[^A-Za-z]*[A-Za-z]")
#: Characters taken on either side of a candidate, bytes of the identifier dictionary, identifiers in it.
AROUND, DICTIONARY_BYTES, IDENTIFIERS = 256, 32768, 4096
#: Added bytes for each character from which a string counts as incompressible.
NOVELTY = 0.85
#: From this length on the entropy stage of the compressor pays: random characters take no more than the bits that their alphabet needs.
LONG = 128

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the pattern spans, in order."""
    low = text.lower()
    found = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def runs(text: str) -> list[tuple[int, int]]:
    """(start, end) of the strings next to a sensitive name: of those that end alike the longest, and the one that the last name tells."""
    found: dict[int, list[int]] = {}
    known = (0, 0)  # the last run, so that names inside it do not read it again
    for name in NAME.finditer(text):
        own = set()
        for between in BETWEEN:
            if not (m := between.match(text, name.end())):
                continue
            start = m.end()
            if not known[0] <= start < known[1]:
                known = RUN.match(text, start).span()
            end = known[1]
            if text[start - 1] in "+/_-" and start - 2 >= name.end() and not text[start - 2].isalnum() and text[start - 2] not in "+/_-":
                start -= 1  # one such sign behind another separator is the first of the string
            least = LEAST_LENGTH if end - start >= LEAST_LENGTH or not MIXED.match(text[start:end]) else LEAST_MIXED
            if end - start < least or end in own or (-1 < text.find("=", start, min(end, start + LONGEST_NAME)) and ASSIGNED.match(text, start, min(end, start + LONGEST_NAME))):
                continue
            own.add(end)
            found.setdefault(end, []).append(start)
            found[end][1:] = [start] if start != found[end][0] else []
    return sorted((s, e) for e, starts in found.items() for s in starts)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings near a sensitive word that touch no base span."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    return [(s, e) for s, e in runs(text) if not any(b < e and s < f for b, _, f in base)]


def masked(text: str, places: list[tuple[int, int]]) -> str:
    """The text with its secrets and candidates blank, so that none is an identifier of another's surroundings."""
    parts, at = [], 0
    for s, e in sorted(places):
        if e > at:
            parts += [text[at:s], " " * (e - max(s, at))]
            at = e
    return "".join(parts) + text[at:]


def outermost(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans that end alike, the longest."""
    return list({x[2]: x for x in sorted(spans, reverse=True)}.values())


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("before", pa.string()), ("word", pa.string()), ("after", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        base_rows, sets, around = [], [], []
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            found = candidates(text, base)
            base_rows.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            sets.append([{"start": s, "end": e, "before": text[max(0, s - AROUND) : s], "word": text[s:e], "after": text[e : e + AROUND]} for s, e in found])
            places = [*((s, e) for s, _, e in base), *found]
            free = masked(text, places)
            near = [free[max(0, s - AROUND) : s] + " " + free[e : e + AROUND] for s, e in places]
            around.append(sorted({w for t in near for w in _IDENTIFIER.findall(t)}))
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(base_rows, pa.list_(span)), pa.array(sets, pa.list_(_CANDIDATE)), pa.array(around, pa.list_(pa.string()))],
            names=["doc_id", "base", "candidates", "identifiers"],
        )


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)


def novelty(before: str, word: str, after: str, dictionary: bytes) -> float:
    """Bytes that `word` adds to its compressed surroundings, for each of its bytes."""
    c = _compressor(dictionary)
    with_word = len(c.compress((before + word + after).encode("utf-8", "replace")))
    without = len(c.compress((before + after).encode("utf-8", "replace")))
    return (with_word - without) / max(1, len(word.encode()))


def limit(word: str) -> float:
    """Added bytes for each character from which `word` hardly compresses: NOVELTY, or what random characters of its alphabet take if that is less."""
    return min(NOVELTY, math.log2(len(set(word))) / 8) if len(word) >= LONG and len(set(word)) > 1 else NOVELTY


def _report(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for base, found in zip(b.column("base").to_pylist(), b.column("candidates").to_pylist(), strict=True):
            spans = [(x["start"], x["kind"], x["end"]) for x in base]
            novel = outermost([(c["start"], 3, c["end"]) for c in found if novelty(c["before"], c["word"], c["after"], dictionary) >= limit(c["word"])])
            counts = [sum(1 for s in spans if s[1] == k) for k in range(3)]
            out.append((*counts, len(novel), hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + novel)))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
        )


def identifier_dictionary(scanned: DataFrame) -> bytes:
    """The identifiers that stand around secrets and candidates in most documents, the most frequent last; DICTIONARY_BYTES at most."""
    counted = scanned.select(F.explode("identifiers").alias("word")).groupBy("word").count()
    top = [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(IDENTIFIERS).collect()]
    return (" ".join(reversed(top)).encode()[-DICTIONARY_BYTES:]) or b"identifier"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Positions are code points, end exclusive. A null text is empty and has no span; a null id stays null; repeated
    rows are answered each; an empty table gives no rows; other columns are neither read nor returned. Spans are
    ordered by start, then kind; base spans are never changed by novel ones.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    candidate = "array<struct<start: long, end: long, before: string, word: string, after: string>>"
    scanned = base.mapInArrow(_scan, f"doc_id long, base array<struct<start: long, kind: int, end: long>>, candidates {candidate}, identifiers array<string>")
    scanned = stored(scanned, "scanned")
    dictionary = identifier_dictionary(scanned)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return scanned.select("doc_id", "base", "candidates").mapInArrow(partial(_report, dictionary=dictionary), schema)
