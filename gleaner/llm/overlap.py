"""Records of evaluation splits that also stand, exactly or almost, in training (problem 1).

Method: a suffix array over partitioned, concatenated texts. Each task lays its portion of the texts
end to end, sorts the suffixes of that portion and cuts the sorted run at splitters that all tasks
share; the runs of one range meet in one task, which merges them. In the merged order the common
prefix of neighbours is measured, and an unbroken stretch of neighbours with common prefixes of a
length is the class of suffixes that share a span of that length. Classes that hold suffixes of both
sides give the pairs of texts to look at; an exact edit distance decides on them, and what the two
texts share is extended to full common runs, which are merged into the coverage of the held-out
record: by one partner for a pair, by all its partners for the report.

The array holds every suffix of a held-out text, but of a training text only those that can matter. A
training text of ``n`` characters within the wanted distance of a partner differs from it by at most
``k = floor(rate * n / (1 - rate))`` edits, so of any ``k + 1`` disjoint spans of it at least one
stands unchanged in the partner, moved by at most ``k``. A training text therefore gives ``k + 1``
suffixes, each with the prefix it must have in common: the span up to the next one's start. A pair
whose lengths allow ``e`` edits shares all its spans but ``e``, so pairs that share fewer are left out
before any text is fetched. No pair within the distance is lost, however many suffixes share a prefix.

The starts are chosen by dynamic programming so that the spans begin where held-out texts rarely go,
by a count of the leading grams of all held-out suffixes, folded into a fixed number of cells; this
bears on speed only. So does ``DEPTH``, to which the order is worked out: a longer span is one of
``DEPTH`` characters, and a span may be cut shorter without losing a pair.

Where short texts share a template, some spans must begin with a gram that a great part of all texts
has, and that class would pair them all. A hot gram, one with more than a fixed share of all held-out
suffixes, therefore stands in the array together with a piece of the text around it: if the span
stands unchanged, the at most ``k`` edits lie in the rest, so of ``k + 1`` disjoint pieces of two
characters one stands unchanged as well. The training side gives those ``k + 1`` pieces that are
rarest, the held-out side all pieces about the gram. In a long text this holds for at least one of the
stretches it is cut into, as not every stretch can have more edits than its share.

Splitters come from a sample of bounded size, as in any sort by ranges. A prefix so frequent that it
fills several ranges is cut by record instead, and a range with many training suffixes for its few
held-out ones is divided among tasks by training record, so no task takes a hot prefix alone.

Texts are handled once however many records share them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.skeleton import public_letters, skeletons
from gleaner.session import materialise, ship

GRAM = 4  # least characters of a span; k + 1 disjoint ones fit any text of 15 characters or more
DEPTH = 24  # characters to which suffixes are ordered, a multiple of four
CELLS = 1 << 17  # into which counts of leading grams are folded
PIECES = 1 << 15  # into which counts of two-character pieces are folded
HOT = 1 << 12  # a gram that begins more than one in so many held-out suffixes is hot
LOT = 2_000  # texts of one length that are placed at once
STRETCH = 136  # characters that one run of dynamic programming covers
RANGE = 1_000_000  # suffixes that one range holds, about
SAMPLE = 50_000  # suffixes of each side that the splitters are read from, about
PIECED = GRAM + 3  # a gram, the mark and a piece
PAIRS = 1 << 20  # pairs of suffixes that are compared at once
KEEP = re.compile("[^\\w￿]+|_+")
MET = ["tid_held", "tid_train", "place", "wanted"]
RUNS = "part int, held boolean, run binary"


def comparable(texts: list[str | None], public: str = "") -> list[str]:
    """Consistent form, lower case, letters and digits only; null counts as empty."""
    whole = "￿".join(x.replace("￿", "") if x else "" for x in skeletons(texts, True, public))
    return KEEP.sub("", whole.lower()).split("￿") if texts else []


def _normalise(min_len: int, public: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = comparable(b.column("text").to_pylist(), public)
            done = pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(texts, pa.string())], ["id", "held_out", "text"])
            yield done.filter(pa.array([len(x) >= min_len for x in texts], pa.bool_()))

    return run


def portions(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` characters, so that long texts don't swell the arrays."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


class Codes:
    """The texts of a portion end to end, as 16-bit codes, with four packed codes at every place.

    Texts are parted by zeros, which no text holds, so a suffix ends where its text does. Characters
    beyond the basic plane share codes with others, which can only add pairs to look at.
    """

    def __init__(self, batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        self.tid = np.array(batch.column("tid").to_pylist(), np.int64)
        self.n = np.array([len(x) for x in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.n + DEPTH)])[:-1]
        flat = np.frombuffer(("\0" * DEPTH).join([*texts, "\0" * GRAM]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code = (flat ^ ((flat >> np.uint64(16)) * np.uint64(40503))) & np.uint64(0xFFFF)
        self.pair = (code[:-1] << np.uint64(16)) | code[1:]
        self.packed = (self.pair[:-2] << np.uint64(32)) | self.pair[2:]

    def places(self, least: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Row and flat place of each suffix of ``least`` or more characters."""
        per = np.maximum(self.n - least + 1, 0)
        row = np.repeat(np.arange(len(self.n)), per)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        return row, self.at[row] + inside

    def prefixes(self, at: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
        """The first ``DEPTH`` characters of the suffixes, four to a column; zeros from ``need`` on."""
        out = np.empty((DEPTH // 4, len(at)), np.uint64)
        for j in range(DEPTH // 4):
            out[j] = self.packed[at + 4 * j]
            if need is not None:
                out[j] &= MASKS[np.clip(need - 4 * j, 0, 4)]
        return out


MASKS = np.array([0, *(((1 << 64) - 1) ^ ((1 << 16 * (4 - j)) - 1) for j in range(1, 5))], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _cell(grams: np.ndarray, cells: int) -> np.ndarray:
    return (_mix(grams) % np.uint64(cells)).astype(np.int64)


def _chance(tid: np.ndarray, what: np.ndarray) -> np.ndarray:
    """A number below 2**32 for each suffix, from its text and what it is there."""
    return _mix(_mix(tid.astype(np.uint64)) + what) >> np.uint64(32)


class Counts:
    """How often grams and pieces begin held-out suffixes, folded into cells, and from where on a gram is hot."""

    def __init__(self, grams: np.ndarray, pieces: np.ndarray, floor: int):
        self.grams, self.pieces = grams, pieces
        self.most = max(floor, int(grams.sum()) // HOT)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.grams[_cell(grams, len(self.grams))]

    def hot(self, grams: np.ndarray) -> np.ndarray:
        return self.of(grams) > self.most


def _count_cells(cells: int):
    """Counts of the leading grams of a partition's suffixes, folded into ``cells``, and behind them those of all its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + PIECES, np.int64)
        for b in portions(batches):
            c = Codes(b)
            _, at = c.places()
            total[:cells] += np.bincount(_cell(c.packed[at], cells), minlength=cells)
            _, at = c.places(2)
            total[cells:] += np.bincount(_cell(c.pair[at], PIECES), minlength=PIECES)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["cell", "n"])

    return run


def cheapest_starts(cost: np.ndarray, spans: int, gram: int) -> np.ndarray:
    """For each column of ``cost`` (start x text) the ``spans`` starts, at least ``gram`` apart, of least total cost.

    Dynamic programming over the number of spans; the first of equally cheap starts is taken. Needs
    ``len(cost) >= (spans - 1) * gram + 1``.
    """
    width, texts = cost.shape
    best = np.zeros((width + gram, texts), np.int64)  # best[i]: least cost with all spans ended by position i
    taken = []
    for j in range(spans):
        here = cost + best[:width]
        here[: j * gram] = np.iinfo(np.int64).max // 4
        low = np.minimum.accumulate(here, axis=0)
        fresh = np.ones(here.shape, bool)
        fresh[1:] = here[1:] < low[:-1]
        taken.append(np.maximum.accumulate(np.where(fresh, np.arange(width)[:, None], 0), axis=0))
        best = np.full((width + gram, texts), np.iinfo(np.int64).max // 4, np.int64)
        best[gram:] = low
    out = np.empty((spans, texts), np.int64)
    upto = np.full(texts, width - 1)
    for j in range(spans - 1, -1, -1):
        out[j] = taken[j][upto, np.arange(texts)]
        upto = out[j] - gram
    return out


def edits_allowed(n: np.ndarray, rate: Fraction) -> np.ndarray:
    """Most edits between a text of ``n`` characters and any partner within ``rate`` of the longer one."""
    return n * rate.numerator // (rate.denominator - rate.numerator)


def stretches(n: int) -> list[tuple[int, int]]:
    """Start and length of the stretches of a long text that are placed by themselves."""
    cuts = [*range(0, n, STRETCH), n]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2 * GRAM + 8:
        del cuts[-2]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def spans_of(n: int, rate: Fraction) -> int:
    """How many spans a stretch of ``n`` characters gives."""
    spans = int(edits_allowed(n, rate)) + 1
    if n < GRAM * spans:
        raise ValueError(f"texts of {n} characters are too short for spans of {GRAM} at this rate")
    return spans


def chosen_spans(c: Codes, counts: Counts, rate: Fraction) -> tuple[np.ndarray, ...]:
    """Row, flat start and length of the ``k + 1`` or more disjoint spans of each text of a portion, and the flat start and length of their stretch.

    Stretches of a long text each give their share of spans, which costs nothing: the shares add up to
    at least ``k + 1``.
    """
    cuts = [(i, a, length) for i, n in enumerate(c.n.tolist()) for a, length in stretches(n)]
    rows, offs, lens = np.array(cuts, np.int64).reshape(-1, 3).T
    out_of, out_at = [], []
    for length in np.unique(lens):
        spans = spans_of(int(length), rate)
        alike = np.flatnonzero(lens == length)
        for mine in np.array_split(alike, -(-len(alike) // LOT)):
            base = c.at[rows[mine]] + offs[mine]
            grid = base[None, :] + np.arange(length - GRAM + 1)[:, None]
            starts = cheapest_starts(counts.of(c.packed[grid]), spans, GRAM)
            out_of.append(np.tile(mine, spans)), out_at.append((base[None, :] + starts).ravel())
    if not out_of:
        return (np.zeros(0, np.int64),) * 5
    of, at = np.concatenate(out_of), np.concatenate(out_at)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    row = rows[of]
    after = np.concatenate([at[1:], [0]])
    end = np.where(np.concatenate([row[1:] == row[:-1], [False]]), after, c.at[row] + c.n[row])
    return row, at, np.minimum(end - at, DEPTH), c.at[row] + offs[of], lens[of]


def _with_pieces(grams: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Prefixes of a hot gram with a piece behind it, parted by a mark that no text holds."""
    out = np.zeros((DEPTH // 4, len(grams)), np.uint64)
    out[0], out[1] = grams, np.uint64(1 << 48) | (pieces << np.uint64(16))
    return out


def _rarest_pieces(c: Codes, at: int, begin: int, length: int, counts: Counts, rate: Fraction) -> np.ndarray:
    """Places of the ``k + 1`` rarest disjoint pieces of a stretch that lie beside the gram at ``at``."""
    grid = np.concatenate([np.arange(begin, at - 1, 2), np.arange(at + GRAM, begin + length - 1, 2)])
    need = int(edits_allowed(length, rate)) + 1
    return grid[np.argsort(counts.pieces[_cell(c.pair[grid], PIECES)], kind="stable")[:need]]


def _once(row: np.ndarray, grams: np.ndarray, which: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the entries of one text that have equal grams and pieces."""
    order = np.lexsort((piece, grams[which], row[which]))
    which, piece = which[order], piece[order]
    fresh = np.ones(len(which), bool)
    fresh[1:] = (row[which][1:] != row[which][:-1]) | (grams[which][1:] != grams[which][:-1]) | (piece[1:] != piece[:-1])
    return which[fresh], piece[fresh]


def _suffixes(c: Codes, held: bool, counts: Counts, rate: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, flat place, needed length and prefix of the suffixes that a portion gives to the array, in lots."""
    if held:
        row, at = c.places()
        need = np.zeros(len(row), np.int64)
    else:
        row, at, need, begin, length = chosen_spans(c, counts, rate)
    hot = counts.hot(c.packed[at])
    plain = np.flatnonzero(~hot)
    yield row[plain], at[plain], need[plain], c.prefixes(at[plain], None if held else need[plain])
    hot = np.flatnonzero(hot)
    if not held:
        beside = [_rarest_pieces(c, at[i], begin[i], length[i], counts, rate) for i in hot.tolist()]
        which = np.repeat(hot, [len(x) for x in beside])
        if not len(which):
            return
        piece = c.pair[np.concatenate(beside)]
        # Spans of a text in one stretch are counted, so each stays; of a longer one any is enough.
        short = c.n[row[which]] <= STRETCH
        of, beyond = _once(row, c.packed[at], which[~short], piece[~short])
        which, piece = np.concatenate([which[short], of]), np.concatenate([piece[short], beyond])
        yield row[which], at[which], np.full(len(which), PIECED), _with_pieces(c.packed[at[which]], piece)
        return
    reach = STRETCH + int(edits_allowed(STRETCH, rate))
    for lot in np.array_split(hot, max(1, len(hot) // 4096)):
        text, end = c.at[row[lot]], c.at[row[lot]] + c.n[row[lot]]
        low, high = np.maximum(text, at[lot] - reach), np.minimum(end - 1, at[lot] + reach)
        per = np.maximum(high - low, 0)
        which = np.repeat(lot, per)
        piece = np.repeat(low, per) + _inside(per)
        apart = (piece + 2 <= at[which]) | (piece >= at[which] + GRAM)
        which, piece = which[apart], c.pair[piece[apart]]
        which, piece = _once(row, c.packed[at], which, piece)
        yield row[which], at[which], np.zeros(len(which), np.int64), _with_pieces(c.packed[at[which]], piece)


def _bytes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Eight characters as bytes that sort as the characters do."""
    return np.ascontiguousarray(np.stack([first, second], 1).astype(">u8")).view("S16").ravel()


def _bounds(prefix: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest eight characters that a suffix with this prefix can begin with."""
    high = [prefix[j] | ~MASKS[np.clip(need - 4 * j, 0, 4)] for j in (0, 1)]
    return _bytes(prefix[0], prefix[1]), _bytes(*high)


def _sampled(held: bool, counts: Counts, rate: Fraction, chance: float):
    """The first eight characters of a part of the suffixes, drawn by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            c = Codes(b)
            for row, at, need, prefix in _suffixes(c, held, counts, rate):
                drawn = np.flatnonzero(_chance(c.tid[row], (at - c.at[row]).astype(np.uint64) + prefix[1]) < np.uint64(int(chance * (1 << 32))))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), pa.int64()) for x in (prefix[0][drawn], prefix[1][drawn])] + [pa.array(need[drawn], pa.int64())], ["a", "b", "need"])

    return run


class Ranges:
    """Which ranges of the order go to which tasks.

    ``splitters`` are ascending and may repeat: equal ones mark a prefix that fills several ranges,
    over which its held-out suffixes are spread by record. A range is divided into ``parts`` tasks by
    training record; its held-out suffixes go to each of them.
    """

    def __init__(self, splitters: np.ndarray, parts: np.ndarray):
        self.splitters, self.parts = splitters, parts
        self.first = np.cumsum(parts) - parts
        self.total = int(parts.sum())

    @staticmethod
    def planned(held: np.ndarray, low: np.ndarray, high: np.ndarray, ranges: int) -> Ranges:
        """From samples: the bytes of held-out suffixes and the bounds of training ones."""
        held = np.sort(held)
        splitters = held[np.arange(1, ranges) * len(held) // ranges] if len(held) else held
        whole = len(splitters) + 1
        begun = np.bincount(np.searchsorted(splitters, low, "left"), minlength=whole + 1)[: whole + 1]
        ended = np.bincount(np.searchsorted(splitters, high, "right") + 1, minlength=whole + 1)[: whole + 1]
        met = np.cumsum(begun - ended)[:whole]
        return Ranges(splitters, np.maximum(1, met * whole // max(1, 4 * len(low))))

    def of_held(self, key: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the suffix and its task; an index for each task of the range."""
        left, right = (np.searchsorted(self.splitters, key, side) for side in ("left", "right"))
        mine = left + (_mix(tid.astype(np.uint64)) % (right - left + 1).astype(np.uint64)).astype(np.int64)
        which = np.repeat(np.arange(len(key)), self.parts[mine])
        return which, self.first[mine[which]] + _inside(self.parts[mine])

    def of_training(self, low: np.ndarray, high: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the suffix and its task; an index for each range where its prefix may go on."""
        left, right = np.searchsorted(self.splitters, low, "left"), np.searchsorted(self.splitters, high, "right")
        which = np.repeat(np.arange(len(low)), right - left + 1)
        mine = left[which] + _inside(right - left + 1)
        return which, self.first[mine] + (_mix(tid[which].astype(np.uint64) + np.uint64(1)) % self.parts[mine].astype(np.uint64)).astype(np.int64)


def _inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of groups that follow each other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _packed_run(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as one value, by planes of bytes, which in sorted order are much alike."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns)
    return len(columns[0]).to_bytes(4, "little") + len(planes).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked_run(value: bytes, kinds: list) -> list[np.ndarray]:
    n, size = int.from_bytes(value[:4], "little"), int.from_bytes(value[4:8], "little")
    planes, out, at = np.frombuffer(pa.Codec("zstd").decompress(value[8:], size), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize * n
        out.append(np.ascontiguousarray(planes[at : at + width].reshape(-1, n).T).view(kind).ravel())
        at += width
    return out


KINDS = [*[np.uint64] * (DEPTH // 4), np.int64, np.int32, np.int32, np.uint8]


def _sorted_runs(held: bool, counts: Counts, rate: Fraction, ranges: Ranges):
    """The suffix array of each portion, cut into one run for each task of the ranges it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            c = Codes(b)
            for row, at, need, prefix in _suffixes(c, held, counts, rate):
                tid = c.tid[row]
                if held:
                    which, part = ranges.of_held(_bytes(prefix[0], prefix[1]), tid)
                else:
                    which, part = ranges.of_training(*_bounds(prefix, need), tid)
                order = np.lexsort((*prefix[::-1, which], part))
                which, part = which[order], part[order]
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                columns = [*prefix[:, which], tid[which], (at - c.at[row])[which].astype(np.int32), c.n[row][which].astype(np.int32), need[which].astype(np.uint8)]
                spans = [(i, j) for i, j in zip(cuts, cuts[1:]) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[i]) for i, _ in spans], pa.int32()), pa.array([held] * len(spans), pa.bool_()), pa.array([_packed_run([x[i:j] for x in columns]) for i, j in spans], pa.binary())],
                    ["part", "held", "run"],
                )

    return run


def common_prefixes(prefix: np.ndarray) -> np.ndarray:
    """How many characters each suffix of a sorted array has in common with the one before it; 0 for the first."""
    out = np.zeros(prefix.shape[1], np.int64)
    same = np.ones(max(0, prefix.shape[1] - 1), bool)
    for column in prefix:
        differs = column[1:] ^ column[:-1]
        equal = np.select([differs >> np.uint64(48) != 0, differs >> np.uint64(32) != 0, differs >> np.uint64(16) != 0, differs != 0], [0, 1, 2, 3], 4)
        out[1:] += np.where(same, equal, 0)
        same &= equal == 4
    return out


def met_in_classes(prefix: np.ndarray, need: np.ndarray, held: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the training and held-out suffixes that share a class, about ``most`` pairs at a time.

    A class for a needed length is a stretch of neighbours in the sorted array whose common prefixes
    all reach it. It ends where a neighbour has less in common, so the classes of a length are numbered
    by counting those places.
    """
    common = common_prefixes(prefix)
    theirs = np.flatnonzero(held)
    for length in np.unique(need[~held]):
        group = np.cumsum(common < length)
        mine, groups = np.flatnonzero(~held & (need == length)), group[theirs]
        low, high = (np.searchsorted(groups, group[mine], side) for side in ("left", "right"))
        some = np.flatnonzero(high > low)
        mine, low, per = mine[some], low[some], (high - low)[some]
        upto = np.concatenate([[0], np.cumsum(per)])
        for begin in range(0, int(upto[-1]), most):
            end = min(begin + most, int(upto[-1]))
            pair = np.arange(begin, end)
            k = np.searchsorted(upto, pair, "right") - 1
            yield mine[k], theirs[low[k] + pair - upto[k]]


def _cross_split(rate: Fraction):
    """Merges the runs of each range and gives the texts whose suffixes meet in a class, in about the same place, with how many spans must."""

    def pairs(runs: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*(_unpacked_run(r, KINDS) for r in runs))]
        runs.clear()
        order = np.lexsort((columns[-1], *columns[: DEPTH // 4][::-1]))
        columns = [x[order] for x in columns]
        tid, place, n, need = columns[DEPTH // 4 :]
        prefix = np.stack(columns[: DEPTH // 4])
        # Compared as wholes, a training suffix is its span alone and so stands before all that go on from it.
        for a, b in met_in_classes(prefix, need.astype(np.int64), need == 0):
            most = np.maximum(n[a], n[b]).astype(np.int64) * rate.numerator // rate.denominator
            # A hot gram with a piece stands once for all its places in a text.
            in_place = (np.abs(place[a].astype(np.int64) - place[b]) <= most) | (prefix[1][a] >> np.uint64(48) == 1)
            near = (np.abs(n[a].astype(np.int64) - n[b]) <= most) & in_place
            lengths, which = np.unique(n[a[near]], return_inverse=True)
            # Of a text in several stretches one span is enough, as a hot one holds only in a stretch with few edits.
            spans = np.array([spans_of(int(m), rate) if m <= STRETCH else 0 for m in lengths], np.int64)[which]
            found = np.unique(np.stack([tid[b[near]], tid[a[near]], place[a[near]], np.maximum(1, spans - most[near])], 1), axis=0)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found.T], MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = None, []
        for b in batches:
            for mine, value in zip(b.column("part").to_pylist(), b.column("run")):
                if mine != part and runs:
                    yield from pairs(runs)
                part = mine
                runs.append(value.as_py())
        if runs:
            yield from pairs(runs)

    return run


def distinct_texts(records: DataFrame) -> DataFrame:
    """``tid, text, in_train, in_held_out``: each text once, however many records share it. To be written before ``tid`` is used."""
    flags = [F.bool_or(~F.col("held_out")).alias("in_train"), F.bool_or("held_out").alias("in_held_out")]
    return records.groupBy("text").agg(*flags).select(F.monotonically_increasing_id().alias("tid"), "text", "in_train", "in_held_out")


def shared_spans(texts: DataFrame, rate: Fraction = Fraction(15, 100), cells: int = CELLS, per_range: int = RANGE, sample: int = SAMPLE, floor: int = 64) -> DataFrame:
    """Pairs of texts across the split that share a span in place: ``tid_held, tid_train``, each once.

    Every pair within ``rate`` is among the pairs. ``cells``, ``per_range`` (suffixes in a range),
    ``sample`` (suffixes the splitters are read from) and ``floor`` (least count of a hot gram) bear on
    speed only.
    """
    spark = texts.sparkSession
    ship(spark)
    texts = texts.select("tid", "text", "in_train", "in_held_out")
    sides = {held: texts.filter("in_held_out" if held else "in_train").select("tid", "text") for held in (True, False)}
    # A fixed number of cells reaches the driver, whatever the input.
    folded = np.zeros(cells + PIECES, np.int64)
    found = sides[True].mapInArrow(_count_cells(cells), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    folded[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    counts = Counts(folded[:cells], folded[cells:], floor)
    size = texts.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("in_held_out"), F.length("text"))).alias("held")).first()
    drawn = {}
    for held, df in sides.items():
        # Some texts are drawn, and of their suffixes so many that about ``sample`` are left.
        share = min(1.0, sample / max(1, size.n))
        some = df.filter(F.pmod(F.xxhash64(F.lit("range"), "tid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        chance = min(1.0, sample / max(1.0, share * (size.chars or 0)))
        got = some.mapInArrow(_sampled(held, counts, rate, chance), "a bigint, b bigint, need bigint").toArrow()
        drawn[held] = [got.column(x).to_numpy().astype(np.int64) for x in ("a", "b", "need")]
    a, b, need = drawn[False]
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.held or 0) // per_range))
    bounds = _bounds(np.stack([a.view(np.uint64), b.view(np.uint64)]), need)
    ranges = Ranges.planned(_bytes(drawn[True][0].view(np.uint64), drawn[True][1].view(np.uint64)), *bounds, wanted)
    runs = [df.mapInArrow(_sorted_runs(held, counts, rate, ranges), RUNS) for held, df in sides.items()]
    met = runs[0].unionByName(runs[1]).repartitionById(ranges.total, "part").sortWithinPartitions("part")
    met = met.mapInArrow(_cross_split(rate), ", ".join(f"{x} bigint" for x in MET))
    # Partitioned by the pair, so that neither step below shuffles again; a span may be met in several tasks.
    each = met.repartition("tid_held", "tid_train").groupBy("tid_held", "tid_train", "place").agg(F.max("wanted").alias("wanted"))
    return each.groupBy("tid_held", "tid_train").agg(F.count("*").alias("n"), F.max("wanted").alias("wanted")).filter("n >= wanted").select("tid_held", "tid_train")


def common_runs(text: str, partner: str) -> list[tuple[int, int]]:
    """Start and end in ``text`` of the stretches made up of runs of ``GRAM`` or more characters that ``partner`` has too.

    A run of that length is the union of its grams, so merging the grams found gives the full runs.
    """
    grams = {partner[j : j + GRAM] for j in range(len(partner) - GRAM + 1)}
    out: list[tuple[int, int]] = []
    for i in range(len(text) - GRAM + 1):
        if text[i : i + GRAM] in grams:
            joins = out and i <= out[-1][1]
            out.append((out.pop()[0] if joins else i, i + GRAM))
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])))
def _runs(text: pa.Array, partner: pa.Array) -> pa.Array:
    runs = [[{"low": i, "high": j} for i, j in common_runs(a, b)] for a, b in zip(text.to_pylist(), partner.to_pylist())]
    return pa.array(runs, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))


def near_texts(texts: DataFrame, rate: Fraction = Fraction(15, 100), **tuning: int) -> DataFrame:
    """Pairs of texts across the split within ``rate``: both texts, ``edits`` and ``runs``, the stretches of the held-out text that the other has."""
    pairs = shared_spans(texts, rate, **tuning)
    one = texts.filter("in_held_out").select(F.col("tid").alias("tid_held"), F.col("text").alias("text_held"))
    two = texts.filter("in_train").select(F.col("tid").alias("tid_train"), F.col("text").alias("text_train"))
    longer = F.greatest(F.length("text_held"), F.length("text_train"))
    return (
        pairs.join(one, "tid_held")
        .join(two, "tid_train")
        .withColumn("edits", F.levenshtein("text_held", "text_train"))
        .filter(F.col("edits") * rate.denominator <= longer * rate.numerator)
        .select("text_held", "text_train", "edits", _runs("text_held", "text_train").alias("runs"))
    )


def held_out_records(utterances: DataFrame, min_len: int = 15) -> DataFrame:
    """``id, held_out, text`` of the utterances with a split and ``min_len`` comparable characters.

    The text is ref, or hyp where ref is null or empty. Rows with a null id or split are left out.
    """
    ship(utterances.sparkSession)
    rows = utterances.filter("id is not null and split in ('train', 'dev', 'eval')")
    text = F.when(F.length("ref") > 0, F.col("ref")).otherwise(F.col("hyp"))
    rows = rows.select("id", (F.col("split") != "train").alias("held_out"), text.alias("text"))
    return rows.mapInArrow(_normalise(min_len, public_letters(utterances.sparkSession)), "id string, held_out boolean, text string")


def _near_records(utterances: DataFrame, rate: Fraction, min_len: int, tuning: dict) -> tuple[DataFrame, DataFrame]:
    """The records, and the pairs of their texts; two hashes, 96 bits in all, stand for a text, so that none travels to be joined with its ids."""
    records = materialise(held_out_records(utterances, min_len), "records")
    near = near_texts(materialise(distinct_texts(records), "texts"), rate, **tuning)
    hashed = lambda column, name: (F.xxhash64(column).alias(f"a_{name}"), F.hash(column).alias(f"b_{name}"))
    near = near.select(*hashed("text_held", "held"), *hashed("text_train", "train"), "edits", F.length("text_held").alias("n"), "runs")
    return records.select("id", "held_out", *hashed("text", "text")), near


def _side(records: DataFrame, held: bool) -> DataFrame:
    name = "held" if held else "train"
    return records.filter("held_out" if held else "not held_out").select(F.col("a_text").alias(f"a_{name}"), F.col("b_text").alias(f"b_{name}"), F.col("id").alias(f"id_{name}"))


def cross_split_pairs(utterances: DataFrame, rate: Fraction = Fraction(15, 100), min_len: int = 15, **tuning: int) -> DataFrame:
    """Pairs of a held-out and a training record, each once: ``id_held, id_train, edits, covered, text, n, runs``.

    ``covered`` is the share of the held-out text's ``n`` characters that lies in ``runs``, the merged
    stretches it has in common with the training text; ``text`` is a hash of it. Of an id stored with
    several texts the nearest counts. Empty input gives an empty result; repeated rows of an id count once; an id that stands on both
    sides is not paired with itself.
    """
    records, near = _near_records(utterances, rate, min_len, tuning)
    pairs = near.join(_side(records, True), ["a_held", "b_held"]).join(_side(records, False), ["a_train", "b_train"]).filter("id_held != id_train")
    # Without the columns of the text, as for the ids alone, the planner leaves out the runs altogether.
    best = F.min(F.struct("edits", F.col("a_held").alias("text"), "n", "runs"))
    pairs = pairs.groupBy("id_held", "id_train").agg(best.alias("best")).select("id_held", "id_train", "best.*")
    covered = F.aggregate("runs", F.lit(0), lambda total, x: total + x["high"] - x["low"]) / F.col("n")
    return pairs.select("id_held", "id_train", "edits", covered.alias("covered"), "text", "n", "runs")


def covered_records(utterances: DataFrame, rate: Fraction = Fraction(15, 100), min_len: int = 15, **tuning: int) -> DataFrame:
    """``id, edits, covered`` of each held-out record with a partner: its nearest partner's edits, and the share of its text that any partner has.

    The runs of all partners are merged as intervals; a place that several partners have counts once.
    Training records that share a text are one partner. Of an id stored with several texts the best
    values count; an id that stands on both sides is no partner of itself.
    """
    records, near = _near_records(utterances, rate, min_len, tuning)
    partners = _side(records, False).groupBy("a_train", "b_train").agg(F.min("id_train").alias("least"), F.max("id_train").alias("most"))
    found = near.join(partners, ["a_train", "b_train"]).join(_side(records, True).distinct(), ["a_held", "b_held"]).filter("id_held != least or id_held != most")
    runs = found.select("id_held", F.col("a_held").alias("text"), "n", "edits", F.explode_outer("runs").alias("run")).select("id_held", "text", "n", "edits", "run.*")
    runs = runs.groupBy("id_held", "text", "low", "high").agg(F.min("edits").alias("edits"), F.max("n").alias("n"))
    before = Window.partitionBy("id_held", "text").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max("high").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("high") - F.greatest("low", upto))
    each = runs.withColumn("fresh", fresh).groupBy("id_held", "text").agg(F.min("edits").alias("edits"), (F.sum("fresh") / F.max("n")).alias("covered"))
    return each.groupBy(F.col("id_held").alias("id")).agg(F.min("edits").alias("edits"), F.max("covered").alias("covered"))


def overlap_report(utterances: DataFrame, **tuning: int) -> DataFrame:
    """Per held-out split and source: records, those that stand in training, exactly or at all, and their share.

    ``mean_covered`` is the mean over those that stand in training of the share of their text that lies
    in runs of ``GRAM`` or more characters of their partners.
    """
    best = covered_records(utterances, **tuning)
    held = utterances.filter("split in ('dev', 'eval')").groupBy("id").agg(F.max("split").alias("split"), F.max("source").alias("source"))
    return (
        held.join(best, "id", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("n_records"),
            F.count("edits").alias("n_overlapping"),
            F.count_if(F.col("edits") == 0).alias("n_exact"),
            F.round(F.count("edits") / F.count("*"), 6).alias("share"),
            F.round(F.avg("covered"), 6).alias("mean_covered"),
        )
    )
