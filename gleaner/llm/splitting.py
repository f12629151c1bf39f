"""Splitting oversized items at natural boundaries (problem 7).

Method: recursive bisection. An item over the limit is cut at the strongest boundary near its
midpoint, and halves that still exceed the limit minus the overlap are cut again; a stretch without
a boundary is halved where it stands. Then each piece but the first gets the end of what precedes it
as overlap.

Paragraph breaks are stronger than line breaks, these stronger than sentence ends. Null and empty
texts give no pieces; texts within the limit give none either, as they need no cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.tokens import FOLDER, VOCABULARY, encoder
from gleaner.session import ship

LINE = "\n\x0b\x0c\r\x85\u2028\u2029"
MARK = f"(?:[{LINE}。！？｡!?]|\\.(?=\\s|\\Z))"
ONE = re.compile(MARK)
CLOSED = re.compile(f"(?:{MARK}[」』）】)\"'”’]*)+")
BREAK = re.compile(f"\r\n|[{LINE}]")
ALIGN = 3  # a character has at most four bytes, so at most three tokens begin within it
PIECES = "limit_name string, piece int, start int, end int, n_tokens int, cut string, text string"


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Where a cut may stand and how strong it is: 3 paragraph, 2 line, 1 sentence.

    Closing brackets and quotes stay with the sentence they close.
    """
    at, strength = [], []
    for m in CLOSED.finditer(text):
        at.append(m.end())
        strength.append(1 + min(2, len(BREAK.findall(m.group()))))
    return at, strength


def edges(text: str) -> list[int]:
    """Where text and boundary characters meet, so that what lies between two neighbours holds no boundary or is one."""
    return sorted({x for m in ONE.finditer(text) for x in m.span()})


def longest_stretch(done: list[tuple[int, int, str]]) -> int:
    """The longest stretch of ``bisected`` pieces that only cuts without a boundary part; 0 without such a cut."""
    longest = begun = 0
    for (_, end, cut), before in zip(done, [None, *done]):
        if before is None or before[2] != "hard":
            begun = before[1] if before else 0
        elif cut != "hard":
            longest = max(longest, end - begun)
    return longest


def bisected(size: int, at: list[int], strength: list[int], limit: int, allowed: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, cut)`` of ``size`` units, each within ``limit``; ``cut`` says what ends it.

    ``at`` holds the boundaries in ascending order, ``allowed`` the sorted units where a cut without
    a boundary may stand; None allows all.
    """
    kinds = {1: "sentence", 2: "line", 3: "paragraph"}
    done, todo = [], [(0, size, "end")]
    while todo:
        a, b, ends = todo.pop()
        if b - a <= limit:
            done.append((a, b, ends))
            continue
        lo, hi = bisect_right(at, a), bisect_left(at, b)
        middle = (a + b) / 2
        if lo < hi:
            quarter = (b - a) / 4
            near = range(bisect_left(at, middle - quarter, lo, hi), bisect_right(at, middle + quarter, lo, hi))
            if len(near):
                best = max(near, key=lambda i: (strength[i], -abs(at[i] - middle), -at[i]))
            else:
                i = bisect_left(at, middle, lo, hi)
                best = min((j for j in (i - 1, i) if lo <= j < hi), key=lambda j: abs(at[j] - middle))
            cut, kind = at[best], kinds[strength[best]]
        else:
            cut, kind = int(middle), "hard"
            if allowed is not None:
                i = int(np.searchsorted(allowed, cut, "right")) - 1
                cut = int(allowed[i]) if allowed[i] > a else int(allowed[i + 1])
                if cut >= b:
                    done.append((a, b, ends))
                    continue
        todo += [(cut, b, ends), (a, cut, kind)]
    return done


class Tokenised:
    """A text as tokens, with the places where tokens and characters begin together."""

    def __init__(self, text: str, enc, lengths: np.ndarray):
        self.text = text
        ids = np.array(enc.encode_ordinary(text), np.int64)
        self.size = len(ids)
        edges = np.concatenate([[0], np.cumsum(lengths[ids])])
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        begins = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])
        place = np.searchsorted(begins, edges)
        self.aligned = np.flatnonzero(begins[np.minimum(place, len(begins) - 1)] == edges)
        self.chars = place[self.aligned]

    def token_at(self, chars: list[int]) -> np.ndarray:
        """The first aligned token at or after each character."""
        return self.aligned[np.searchsorted(self.chars, chars)]

    def char_at(self, token: int) -> int:
        return int(self.chars[np.searchsorted(self.aligned, token)])

    def back_from(self, token: int) -> int:
        """The last aligned token at or before ``token``."""
        return int(self.aligned[np.searchsorted(self.aligned, token, "right") - 1])


def pieces(t: Tokenised, enc, most: int, overlap: int) -> Iterator[tuple[int, int, int, int, str]]:
    """``(number, start, end, tokens, cut)`` in characters; consecutive pieces share ``overlap`` tokens."""
    at, strength = boundaries(t.text)
    units: dict[int, int] = {}
    for u, s in zip(t.token_at(at).tolist() if at else [], strength):
        units[u] = max(s, units.get(u, 0))
    limit = most - overlap - (ALIGN if overlap else 0)
    if limit <= ALIGN:
        raise ValueError("the overlap leaves no room in a piece")
    for number, (a, b, cut) in enumerate(bisected(t.size, [*units], [*units.values()], limit, t.aligned)):
        start = t.back_from(max(0, a - overlap)) if number else a
        end = t.char_at(b)
        while True:
            first = t.char_at(start)
            # A piece cut within a word may take other tokens than the whole text does there.
            n = len(enc.encode_ordinary(t.text[first:end]))
            later = int(np.searchsorted(t.aligned, start, "right"))
            if n <= most or t.aligned[later] >= b:
                break
            start = int(t.aligned[later])
        yield number, first, end, n, cut


def _split(limits: list[tuple[str, int, int]], folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, vocabulary)
        lengths = np.array([len(x) for x in map(enc.decode_single_token_bytes, range(enc.n_vocab))], np.int64)
        least = min((most for _, most, _ in limits), default=0)
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for k, x in enumerate(b.column("text").to_pylist()):
                if len(x.encode()) <= least:
                    continue
                t = Tokenised(x, enc, lengths)
                for name, most, overlap in limits:
                    if t.size > most:
                        for number, start, end, n, cut in pieces(t, enc, most, overlap):
                            for o, v in zip(out, (k, name, number, start, end, n, cut, x[start:end])):
                                o.append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ["limit_name", "piece", "start", "end", "n_tokens", "cut", "text"]
            arrays = [pa.array(o, t) for o, t in zip(out[1:], kinds)]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(out[0], pa.int64())), *arrays], ["key", *names])

    return run


def split_texts(documents: DataFrame, key: str, text: str, limits: list[tuple[str, int, int]], folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Ordered pieces of the texts over each limit ``(name, most tokens, overlap)``.

    Gives ``key, limit_name, piece, start, end, n_tokens, cut, text``; places are in characters of the
    whole text, ``cut`` is what the piece ends at: paragraph, line, sentence, hard or end. Each text is
    tokenised once for all limits. No shuffle. Repeated keys give their pieces again, a null key passes,
    other columns are left out. A key named like another output comes out as ``key``.
    """
    named = "key" if f"{key} " in PIECES else key
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInArrow(_split(limits, folder, vocabulary), f"key {kind}, {PIECES}").withColumnRenamed("key", named)


def _unbroken(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, stretch = [], []
            for k, x in enumerate(b.column("text").to_pylist()):
                at = edges(x)
                if n := longest_stretch(bisected(len(x), at, [1] * len(at), limit)):
                    keep.append(k), stretch.append(n)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keep, pa.int64())), pa.array(stretch, pa.int32())], ["key", "stretch"])

    return run


def unbroken_texts(documents: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key, stretch`` of texts that bisection to ``limit`` characters has to cut without a boundary.

    ``stretch`` is the longest run of characters without one. Repeated keys come out once for each row.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    return rows.mapInArrow(_unbroken(limit), f"key {kind}, stretch int").withColumnRenamed("key", "key" if key == "stretch" else key)
