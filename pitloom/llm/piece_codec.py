"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a segment the table stores the one token that ends the prefix's own encoding. An automaton over
all pieces lists the tokens that end at a position; the one that is compatible with the last token of the prefix
before it (no merge across the border would have come first) is stored. Ids are recovered from the end backwards.
The work is linear in the text, and no merge queue is needed.

No piece holds a space mark behind another character, so a text falls into space-led chunks that are encoded alone;
a bounded table of chunks is kept by each Python worker. Runs of spaces, whose pieces share one score and so have no
order among themselves, are merged by the leftmost-first rule directly.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks that a worker keeps; the table is emptied when full.
CHUNKS = 200_000


def default_model() -> str:
    """Path of the public 32k piece model, where the tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Table(dict):
    """Remembers what `make` returns; of the last two generations of CHUNKS / 2 entries, those asked for again stay."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= CHUNKS // 2:
            self.older = dict(self)
            self.clear()
        value = self[key] = self.older[key] if key in self.older else self.make(key)
        return value


class PieceCodec:
    """Encoder and decoder for a SentencePiece model of type BPE with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.rank: list[float] = [0.0] * len(self.pieces)
        self.unknown_id = sp.unk_id()
        self.silent = set()
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif sp.is_control(i) or sp.is_unknown(i):
                self.silent.add(i)
            else:
                self.ids[p] = i
                self.rank[i] = -1.0 if len(p) == 1 else -sp.get_score(i)
        for p in self.ids:
            if any(c not in self.ids for c in p):
                raise ValueError(f"piece {p!r} holds a character that is no piece")
            if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)):
                raise ValueError(f"piece {p!r} crosses a chunk border")
        self.has_newline_piece = any("\n" in p for p in self.ids)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        for p, i in self.ids.items():
            if self.split(i) is not None:  # merging never makes the others
                automaton.add_word(p, (i, len(p)))
        automaton.make_automaton()
        self.automaton = automaton
        self.known = frozenset(c for c in self.ids if len(c) == 1)
        self.shown = [None if i in self.byte_of or i in self.silent else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.led = _Table(lambda w: self.entry(self.chunk(SPACE + w)))
        self.bare = _Table(lambda w: self.entry(self.chunk(w)))
        self.runs = _Table(lambda n: self.entry(self.spaces(n)))
        self.newline = self.entry((self.byte_ids[10],))

    def entry(self, ids) -> tuple[int, str, str]:
        """What is kept of a chunk: number of ids, ids joined by commas, the text that they stand for."""
        return len(ids), ",".join(map(self.digits.__getitem__, ids)), self.render(ids)

    # -- merge types ---------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[tuple[int, int, int]]:
        """Plain merging of a short string: (id, id of left part, id of right part) of what is left, -1 for no parts."""
        symbols: list[tuple[int, int, int] | None] = [(self.ids[c], -1, -1) for c in text]
        after = list(range(1, len(text) + 1))
        before = list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(text):
                a, b = symbols[i][0], symbols[j][0]
                if (c := self.ids.get(self.pieces[a] + self.pieces[b])) is not None:
                    heapq.heappush(queue, (self.rank[c], i, j, a, b))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, a, b = heapq.heappop(queue)
            if symbols[i] is None or symbols[j] is None or symbols[i][0] != a or symbols[j][0] != b or after[i] != j:
                continue
            symbols[i], symbols[j] = (self.ids[self.pieces[a] + self.pieces[b]], a, b), None
            after[i] = after[j]
            if after[j] < len(text):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s is not None]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token` when its text stands alone; (-1, -1) for a character; None if merging never makes it."""
        if token not in self.parts:
            left = self.merge(self.pieces[token])
            self.parts[token] = left[0][1:] if len(left) == 1 else None
        return self.parts[token]

    def fit(self, first: int, second: int) -> bool:
        """Whether `first` and `second` may stand side by side: undoing their merges, latest first, no pair at the
        border would have been merged before the younger of the two merges that took its members away."""
        key = first << 20 | second
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._fit(first, second)
        return known

    def _fit(self, left: int, right: int) -> bool:
        taken_left = taken_right = float("inf")  # ranks of the merges that consume the two border tokens
        while True:
            joined = self.ids.get(self.pieces[left] + self.pieces[right])
            # of two equal merges the one further left comes first
            if joined is not None and self.rank[joined] < taken_left and self.rank[joined] <= taken_right:
                return False
            if self.rank[left] < 0 and self.rank[right] < 0:
                return True
            if self.rank[left] > self.rank[right]:
                taken_left, left = self.rank[left], self.split(left)[1]
            else:
                taken_right, right = self.rank[right], self.split(right)[0]

    # -- encoding ------------------------------------------------------------------------------------------------

    def segment(self, text: str) -> list[int]:
        """Ids of a string of known characters, by its prefix table."""
        whole = self.ids.get(text)
        if whole is not None and self.split(whole) is not None:
            return [whole]
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        fits, fit, done = self.fits, self.fit, -1
        for end, (token, n) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - n
            if start:
                key = last[start] << 20 | token
                if not (fits[key] if key in fits else fit(last[start], token)):
                    continue
            done = end
            last[end + 1], size[end + 1] = token, n
        ids = []
        at = len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a chunk; characters that are no piece part it and become their bytes."""
        if len(self.fits) > 500_000:
            self.fits.clear()
        if self.known.issuperset(text):
            return tuple(self.segment(text)) if text else ()
        ids: list[int] = []
        start = 0
        known = self.ids
        for at, c in enumerate(text):
            if c not in known:
                if at > start:
                    ids += self.segment(text[start:at])
                ids += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = at + 1
        if start < len(text):
            ids += self.segment(text[start:])
        return tuple(ids)

    def spaces(self, n: int) -> tuple[int, ...]:
        return tuple(s[0] for s in self.merge(SPACE * n))

    def chunks(self, text: str) -> list[tuple[int, str, str]]:
        """The entries of a text's chunks, in order."""
        if not text:
            return []
        spaced = " " + text.replace(SPACE, " ")
        lines = [spaced] if self.has_newline_piece else spaced.split("\n")
        lone = str(self.ids[SPACE])
        found: list[tuple[int, str, str]] = []
        for k, line in enumerate(lines):
            if k:
                found.append(self.newline)
            head, *words = line.split(" ")
            if head:
                found.append(self.bare[head])
            if "" not in words:
                found += map(self.led.__getitem__, words)
                continue
            run = 0
            for w in words:
                run += 1
                if not w:
                    continue
                n, ids, shown = self.led[w]
                first, _, rest = ids.partition(",")
                if first == lone:  # the word leaves its space alone, so it joins the run
                    found.append(self.runs[run])
                    found.append((n - 1, rest, shown[1:]))
                else:
                    if run > 1:
                        found.append(self.runs[run - 1])
                    found.append((n, ids, shown))
                run = 0
            if run:
                found.append(self.runs[run])
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.chunks(text) for i in ids.split(",")]

    # -- decoding ------------------------------------------------------------------------------------------------

    def render(self, ids) -> str:
        """The text of ids, the leading space kept; runs of byte tokens are read as UTF-8, each bad byte as U+FFFD."""
        try:
            return "".join([self.shown[i] for i in ids])
        except TypeError:
            pass  # byte tokens or marks among them
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i not in self.silent:
                out.append(self.shown[i])
            elif i == self.unknown_id:
                out.append(" ⁇ ")
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of ids without the space that encoding puts in front."""
        shown = self.render(ids)
        return shown[1:] if shown.startswith(" ") else shown

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        found = self.chunks(text)
        ids = ",".join([e[1] for e in found])
        shown = "".join([e[2] for e in found])
        shown = shown[1:] if shown.startswith(" ") else shown
        return sum([e[0] for e in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def _utf8(raw: bytes) -> str:
    """Characters where they are whole, U+FFFD for each byte that belongs to none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    """One codec for each model and Python worker."""
    return PieceCodec(model)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for b in batches:
        done = [c.round_trip(t or "") for t in b.column("text").to_pylist()]
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], schema=_DIGEST)


def encode_digests(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, SHA-256 of its comma-joined ids and of the text decoded from them.

    A null text is empty: no ids, empty decoded text. A null id stays null; repeated rows are answered each. No
    exchange takes place, so a very long text costs its own time only. Other columns are neither read nor returned.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(partial(_digests, model=model or default_model()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for b in batches:
        ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(partial(_encoded, model=model or default_model()), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    c = codec(model)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of each row of doc_id and ids; null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, model=model or default_model()), "doc_id long, text string")
