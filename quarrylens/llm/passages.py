"""Operator 3: substring dedup by paragraph MinHash banding.

Paragraphs are lines of at least `least` words, and what hard-wrapped lines make (lines of up to WRAP signs with no blank one between).
They are banded: least hashes of a paragraph's word 3-grams, in as many bands and rows as the threshold and RECALL ask for (shape()).
Paragraphs that share a band join, the join's components gather what has to be compared, and inside a component the exact Jaccard of the 3-gram
sets decides about each pair that shares a band. A component of more than HOT paragraphs is compared band by band, and band in pairs of
blocks, so that none is gathered in one place. Of each cluster the first paragraph stays, in the order of id, text and place.

What is equal in all its words is looked for as well: whole texts and paragraphs; sentence runs (from each sentence start the least whole
sentences that have WORDS words); and windows of WORDS words wherever they start: of each REACH windows in a row the one of least hash is
posted, and so is each segment, from one posted window to the end of the next, so that a repeat of WORDS + REACH - 1 words shares a window
with its like wherever it lies. Shared segments are compared as they are; beside a shared window every window is, up to REACH away, but on a
side with a shared segment whose first document is that of both its windows. A repeat of 50 words is found whole, to the word: one that
holds neither window of a segment is shorter.

What is removed has a kept copy. Near paragraphs are settled first: the first of a cluster loses nothing to another cluster, and of the others
a run of WORDS words and more that the first lacks (none of its 3-grams is there) stays. What they lose is masked, and equal words are looked
for in what is left: of each run the first place stays, in the order of id, text and place. So each removed word of a run is found again,
within the same run of words, at an earlier place, and following these places ends at text that stays.

Defined results: words are runs free of white space; each sign of a script that is written without spaces (Chinese, Japanese, Thai, Lao,
Khmer, Burmese, Tibetan) is a word of its own. Lines of fewer than `least` words recur by chance (headings, brackets, list items) and stay
unless a longer repeat holds them. Null, empty and short texts have no paragraphs. Rows of equal id and text are one document, whose own copy is no
repeat; rows of a null id come last in the order. Documents are told apart by id and 128 bits of their text's hash; texts that agree in 64
of them only (a chance of 3 in 10^8 for a million texts) are neither compared nor changed. Offsets count signs, from
0, end excluded. Extra columns pass through dedup() whatever their names. An empty table gives no spans.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.components import components
from quarrylens.llm.jaccard import groups
from quarrylens.llm.textblock import MULT, blocks, col, eased, free, gram_hash, mix, put_lists, put_strings, raw, renamed, span_hash, text_nulls, word_spans
from quarrylens.runtime import discard, materialize, ship, small_side

WORDS = 20
LEAST = 8  # words of a line or wrapped paragraph
WRAP = 120  # signs of the longest hard-wrapped line
REACH = 31  # windows in a row of which one is posted: repeats of 50 words are found
N = 3
THRESHOLD = 0.7
RECALL = 0.99  # chance that a pair of the threshold shares a band
PARTS = 4  # of bands and of picks, that are brought together one after another, so that a fraction of them is on disk in a shuffle at a time
FEW = 32 << 20  # bytes of a table of marks that is broadcast, where else whole texts would be shuffled
HOT = 4000  # paragraphs of a component that one task compares
_R = np.random.RandomState(41)
SEEDS = (_R.randint(0, 2**62, 512).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
BASE2 = np.uint64(0xD6E8FEB86659FD93)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_WIDE_ENDS = [ord(c) for c in "。！？｡।॥"]
# scripts without spaces: Thai and Lao; Tibetan; Burmese; Khmer; Chinese and Japanese with their signs; the same, compatible and full-width
_UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x3190, 0xA4CF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF)]


def shape(threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bands, and rows of each: the most rows for which at most 12 bands give the recall at the threshold, or one row."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    need = lambda r: 1 if threshold == 1 else math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
    rows = max((r for r in range(1, 11) if need(r) <= 12), default=1)
    return need(rows), rows


def _inverse(base: int) -> int:
    x = base
    for _ in range(6):
        x = x * (2 - base * x) % 2**64
    return x


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> dict[str, np.ndarray]:
    if not _TABLES or len(_TABLES["p1"]) <= n:
        size = max(1 << 16, 2 * n)
        for name, base in (("1", int(MULT)), ("2", int(BASE2))):
            _TABLES["p" + name] = _powers(base, size)
            _TABLES["i" + name] = _powers(_inverse(base), size)
    return _TABLES


def run_hash(words: np.ndarray, first: np.ndarray, last: np.ndarray, k: str = "1") -> np.ndarray:
    """A hash of each run of words [first, last), the same for the same words anywhere."""
    t = _power_tables(len(words))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * t["p" + k][: len(words)], out=sums[1:])
        return mix((sums[last] - sums[first]) * t["i" + k][first] + (last - first).astype(np.uint64)).view(np.int64)


def run_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """run_hash() and 32 bits of another."""
    return run_hash(words, first, last), (run_hash(words, first, last, "2") >> 32).astype(np.int32)


def wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of the signs of three bytes."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[data[at] < 0xF0]
    b = [data[at + k].astype(np.int32) for k in range(3)]
    return at, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63


def signs_apart(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans(), with each sign of a script without spaces as a word."""
    starts, ends, doc = word_spans(data, offs)
    at, point = wide(data)
    lone = np.zeros(len(at), bool)
    for lo, hi in _UNSPACED:
        lone |= (point >= lo) & (point <= hi)
    lone &= point != 0x3000  # a space
    at = at[lone]
    far = np.flatnonzero(data == 0xF0)
    far = far[data[far + 1] >= 0xA0]  # Chinese of the planes from 2 on
    if not len(at) and not len(far):
        return starts, ends, doc
    cuts = np.concatenate([at, at + 3, far, far + 4])
    starts, ends = np.union1d(starts, np.setdiff1d(cuts, ends)), np.union1d(ends, np.setdiff1d(cuts, starts))
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


class Paragraphs:
    """Words, sentences and lines of a block of texts."""

    def __init__(self, col: pa.Array):
        self.data, self.offs = raw(col)
        self.starts, self.ends, self.doc = signs_apart(self.data, self.offs)
        self.hash = span_hash(self.data, self.starts, self.ends)
        self.sign = np.zeros(len(self.data) + 1, np.int64)  # signs before a byte
        np.cumsum((self.data.view(np.int8) >= -64).astype(np.int64), out=self.sign[1:])
        n = len(self.starts)
        new_doc = np.ones(n, bool)
        new_doc[1:] = self.doc[1:] != self.doc[:-1]
        breaks = np.bincount(np.searchsorted(self.starts, np.flatnonzero(self.data == 10)), minlength=n + 1)  # before each word
        self.new_line = new_doc.copy()
        self.new_block = new_doc.copy()
        self.new_line[1:] |= breaks[1:n] != 0
        self.new_block[1:] |= breaks[1:n] > 1
        stop = np.zeros(n, bool)
        for back in range(1, 5):
            at = self.ends - back
            stop |= _ENDS[self.data[np.maximum(at, 0)]] & (at >= self.starts)
        at, point = wide(self.data)
        at = at[np.isin(point, _WIDE_ENDS)] + 2
        word = np.searchsorted(self.starts, at, side="right") - 1
        stop[word[self.ends[word] - at <= 4]] = True
        self.new_sentence = self.new_line.copy()
        self.new_sentence[1:] |= stop[:-1]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last word (excluded) of the sentence runs."""
        n = len(self.starts)
        first = np.flatnonzero(self.new_sentence)
        ends = np.append(first[1:], n)
        doc_end = np.searchsorted(self.doc, self.doc[first], side="right") if n else first
        want = first + WORDS
        i = np.minimum(np.searchsorted(ends, want), max(0, len(ends) - 1))
        last = ends[i] if n else ends
        ok = (want <= doc_end) & (last <= doc_end)
        return first[ok], last[ok]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last word (excluded) of all windows of WORDS words inside a text."""
        first = np.arange(max(0, len(self.starts) - WORDS + 1))
        first = first[self.doc[first] == self.doc[first + WORDS - 1]]
        return first, first + WORDS

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of the windows that are least of some REACH in a row, or of all their text has."""
        first, last = self.windows()
        h = run_hash(self.hash, first, last)
        doc = self.doc[first]
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(doc)))
        least = np.repeat(np.minimum.reduceat(h, cut), size) if len(doc) else h
        some = (h == least) & (np.repeat(size, size) < REACH)
        if len(h) >= REACH:
            low, place, wide_ = h, np.arange(len(h)), 1  # the least of so many in a row, and the first place of it
            while wide_ < REACH:
                by = min(wide_, REACH - wide_)
                a, b = low[:-by], low[by:]
                place = np.where(a <= b, place[:-by], place[by:])
                low, wide_ = np.minimum(a, b), wide_ + by
            some[place[doc[: len(place)] == doc[REACH - 1 :]]] = True
        at = np.flatnonzero(some)
        return first[at], h[at]

    def texts(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last word (excluded) of the texts of at least so many words."""
        cut = np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1])) if len(self.doc) else np.zeros(0, np.int64)
        last = np.append(cut[1:], len(self.doc)) if len(cut) else cut
        ok = last - cut >= least
        return cut[ok], last[ok]

    def lines(self, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """First and last word (excluded) of the lines of so many words, and of the paragraphs of several wrapped lines."""
        first = np.flatnonzero(self.new_line)
        last = np.append(first[1:], len(self.starts))
        long = self.sign[self.ends[last - 1]] - self.sign[self.starts[first]] > WRAP if len(first) else np.zeros(0, bool)
        begins = self.new_block[first] | long
        begins[1:] |= long[:-1]
        block = np.flatnonzero(begins)
        lines = np.diff(np.append(block, len(first)))
        block_last = last[block + lines - 1]
        first, last = np.append(first, first[block][lines > 1]), np.append(last, block_last[lines > 1])
        ok = last - first >= least
        return first[ok], last[ok]

    def place(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign offsets, in their texts, of runs of words."""
        base = self.sign[self.offs[self.doc[first]]]
        return (self.sign[self.starts[first]] - base).astype(np.int32), (self.sign[self.ends[last - 1]] - base).astype(np.int32)

    def grams(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """3-gram hashes of lines, and the line of each."""
        lens = last - first
        line = np.repeat(np.arange(len(first)), lens)
        words = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first, lens)
        h, at = gram_hash(self.hash[words], line, N)
        return h, line[at]


def bands(grams: np.ndarray, line: np.ndarray, count: int, shape: tuple[int, int]) -> np.ndarray:
    """(lines, bands) keys."""
    first = np.searchsorted(line, np.arange(count))
    out = np.zeros((count, shape[0]), np.uint64)
    with np.errstate(over="ignore"):
        h, high = np.empty_like(grams), np.empty_like(grams)
        for k, seed in enumerate(SEEDS[: shape[0] * shape[1]]):
            np.multiply(grams, seed, out=h)
            np.right_shift(h, np.uint64(31), out=high)
            np.bitwise_xor(h, high, out=h)
            low = np.minimum.reduceat(h, first)
            b = k // shape[1]
            out[:, b] = mix(out[:, b] * MULT + low + np.uint64(b + 1))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)  # two of one key that differ cost a comparison


def _emit_lines(least: int, shape: tuple[int, int]):
    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                p = Paragraphs(b.column(2))
                first, last = p.lines(least)
                h = run_hash(p.hash, first, last)
                s, e = p.place(first, last)
                at = pa.array(p.doc[first])
                grams, line = p.grams(first, last)
                key = bands(grams, line, len(first), shape) if len(first) else np.zeros((0, shape[0]), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(at), b.column(1).take(at), pa.array(s), pa.array(e), put_lists(key.ravel(), np.full(len(first), shape[0]), pa.int32())], ["h", "d", "t", "s", "e", "bands"])

    return run


def _emit_pieces(least: int):
    """Sentence runs and lines."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                p = Paragraphs(b.column(2))
                first, last = (np.concatenate(x) for x in zip(p.runs(), p.lines(least), strict=True))
                h, h2 = run_hashes(p.hash, first, last)
                s, e = p.place(first, last)
                at = pa.array(p.doc[first])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), b.column(0).take(at), b.column(1).take(at), pa.array(s), pa.array(e)], ["h", "h2", "d", "t", "s", "e"])

    return run


def _novel(batches):
    """Of lines with the 3-grams of the first of their cluster: the runs of WORDS words and more that the first lacks, as words of the line."""
    for b in batches:
        own, first = b.column(2), b.column(3)
        rows, a, z = [], [], []
        for i in range(b.num_rows):
            new = ~np.isin(np.asarray(own[i].values), np.asarray(first[i].values))
            edge = np.diff(np.concatenate([[0], new.astype(np.int8), [0]]))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            lo, hi = np.where(lo > 0, lo + N - 1, 0), np.where(hi < len(new), hi, hi + N - 1)  # the words of no known gram
            some = hi - lo >= WORDS
            rows.append(np.full(int(some.sum()), i))
            a.append(lo[some])
            z.append(hi[some])
        if rows:
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(a).astype(np.int32)), pa.array(np.concatenate(z).astype(np.int32))], ["line", "head", "a", "z"])


def _mask(batches):
    """Texts whose near spans (s, e, kd, novel words; of no kd: the first of a cluster, which stays) are masked, a line end a sign, and what is masked."""
    for batch in batches:
        for b in blocks(batch, "text"):
            p = Paragraphs(b.column(2))
            lead = (p.data & 0xC0) != 0x80
            sign = p.sign
            begin = np.searchsorted(p.doc, np.arange(b.num_rows + 1))
            drop = np.zeros(int(lead.sum()), bool)
            texts, spans = [], []
            word_sign = sign[p.starts]
            for i, list_ in enumerate(b.column(3).to_pylist()):
                base, size = int(sign[p.offs[i]]), int(sign[p.offs[i + 1]] - sign[p.offs[i]])
                gone = np.zeros(size, bool)
                for x in list_:
                    if not x["head"]:
                        gone[x["s"] : x["e"]] = True
                for x in list_:
                    if x["head"]:
                        gone[x["s"] : x["e"]] = False
                    elif x["novel"]:
                        w = begin[i] + int(np.searchsorted(word_sign[begin[i] : begin[i + 1]], base + x["s"]))
                        for y in x["novel"]:
                            gone[word_sign[w + y["a"]] - base : int(sign[p.ends[w + y["z"] - 1]]) - base] = False
                drop[base : base + size] = gone
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                parts = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                spans.append([{"s": max(a, x["s"]), "e": min(z, x["e"]), "kd": x["kd"]} for x in list_ if not x["head"] for a, z in parts if a < x["e"] and x["s"] < z])
            # a dropped sign is one line end: its first byte is kept as such
            sign_of = np.cumsum(lead) - 1
            of = drop[sign_of] if len(sign_of) else np.zeros(0, bool)
            keep = ~of | lead
            data = np.where(of & lead, np.uint8(10), p.data)[keep]
            offs = np.concatenate([[0], np.cumsum(keep)])[p.offs]
            texts = put_strings(data, offs)
            kind = b.schema.field(3).type.value_type.field("kd").type
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts, pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kd", kind)])))], ["d", "t", "text", "gone"])


def _emit_picks(batches):
    """Keys of the picks, as role 0, and of the segments that begin with them, as role 1."""
    for batch in batches:
        for b in blocks(batch, "text"):
            p = Paragraphs(b.column(2))
            first, h = p.picks()
            i, a, z = segments(p, first)
            g = run_hash(p.hash, a, z)
            first = np.concatenate([first, first[i]])
            doc = p.doc[first]
            place = (first - np.searchsorted(p.doc, doc)).astype(np.int32)
            role = np.repeat(np.array([0, 1], np.int32), [len(h), len(g)])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, g])), b.column(0).take(at), b.column(1).take(at), pa.array(place), pa.array(role)], ["h", "d", "t", "at", "role"])


def segments(p: Paragraphs, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each two picks in a row of one text: the place of the former among the picks, and the first and last word (excluded) of both."""
    same = np.flatnonzero(p.doc[first[1:]] == p.doc[first[:-1]]) if len(first) else np.zeros(0, np.int64)
    return same, first[same], first[same + 1] + WORDS if len(same) else first[:0]


def _emit_near(least: int):
    """What _emit_pieces() gives and, of texts with their shared picks and segments (first word, role, hash of the first document's id): the shared segments, and the windows
    beside a shared pick, up to REACH words away, but on a side with a shared segment of the same first document."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                p = Paragraphs(b.column(2))
                first, _ = p.picks()
                begin = np.searchsorted(p.doc, np.arange(b.num_rows + 1))
                lists = b.column(3)
                at, role, head = (np.asarray(lists.flatten().field(k)).astype(np.int64) for k in range(3))
                at += begin[np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(lists)))]
                have = np.zeros((2, len(first)), bool)  # picks, segments that begin with them
                heads = np.zeros((2, len(first)), np.int64)
                place = np.searchsorted(first, at)
                have[role, place] = True
                heads[role, place] = head
                shared, right = have
                i, a, z = segments(p, first)
                joined = np.zeros(len(first), bool)  # by the segment behind a pick
                joined[i] = right[i] & (heads[1, i] == heads[0, i]) & (heads[1, i] == heads[0, i + 1])
                left = np.zeros(len(first), bool)
                left[i + 1] = joined[i]
                near = np.zeros(len(p.starts) + 1, np.int64)
                lo, hi = begin[p.doc[first]], begin[p.doc[first] + 1]
                for at, start, end in ((shared & ~left, first - REACH + 1, first + 1), (shared & ~joined, first, first + REACH)):
                    np.add.at(near, np.maximum(start, lo)[at], 1)
                    np.add.at(near, np.minimum(end, hi)[at], -1)
                w, w_end = p.windows()
                some = (np.cumsum(near) > 0)[w]
                some[np.searchsorted(w, first[shared])] = True
                pieces = zip(p.runs(), p.lines(least), strict=True)
                a, z = (np.concatenate([*x, y[right[i]], v[some]]) for x, y, v in zip(pieces, (a, z), (w, w_end), strict=True))
                h, h2 = run_hashes(p.hash, a, z)
                s, e = p.place(a, z)
                at = pa.array(p.doc[a])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h2), b.column(0).take(at), b.column(1).take(at), pa.array(s), pa.array(e)], ["h", "h2", "d", "t", "s", "e"])

    return run


def _emit_grams(least: int, shape: tuple[int, int]):
    """3-grams and bands of the lines whose hashes are in column wanted."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                p = Paragraphs(b.column(2))
                first, last = p.lines(least)
                h = run_hash(p.hash, first, last)
                some = np.isin(h, np.asarray(b.column(3).flatten()))
                h, at = np.unique(h[some], return_index=True)
                grams, line = p.grams(first[some][at], last[some][at])
                key = bands(grams, line, len(h), shape) if len(h) else np.zeros((0, shape[0]), np.int32)
                size = np.bincount(line, minlength=len(h)) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), put_lists(grams.view(np.int64), size, pa.int64()), put_lists(key.ravel(), np.full(len(h), shape[0]), pa.int32())], ["line", "grams", "bands"])

    return run


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def gram_sets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct values of each list, and these, numbered from 0, one list after another."""
    _, flat = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    most = int(flat.max(initial=0)) + 1
    code = np.sort(np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists))) * most + flat)
    code = code[np.diff(code, prepend=-1) > 0]
    return np.bincount(code // most, minlength=len(lists)), code % most


def alike(same: np.ndarray, root: np.ndarray, size: np.ndarray, begin: np.ndarray, flat: np.ndarray, mark: np.ndarray, threshold: float):
    """Pairs of the lines same, of different roots, whose sets flat[begin : begin + size] have the threshold's Jaccard: each line against all
    behind it at once. The caller may join roots meanwhile."""
    values = flat[ranges(begin[same], size[same])]
    lens = size[same]
    offs = np.cumsum(lens) - lens
    for i, x in enumerate(same[:-1].tolist()):
        n, m = size[x], lens[i + 1 :]
        some = i + 1 + np.flatnonzero((root[same[i + 1 :]] != root[x]) & (np.minimum(n, m) >= threshold * np.maximum(n, m)))
        if not len(some):
            continue
        mark[values[offs[i] : offs[i] + n]] = 1
        if 4 * len(some) < len(m):
            both = np.add.reduceat(mark[values[ranges(offs[some], lens[some])]], np.cumsum(lens[some]) - lens[some])
        else:
            both = np.add.reduceat(mark[values[offs[i + 1] :]], offs[i + 1 :] - offs[i + 1])[some - i - 1]
        mark[values[offs[i] : offs[i] + n]] = 0
        for y in same[some[both >= threshold * (n + lens[some] - both)]].tolist():
            yield x, y


def _clusters(threshold: float, bands_n: int):
    """Inside each candidate component, the clusters of lines that are joined by verified pairs of a shared band."""

    def run(batches):
        for table in groups(batches, "c", 4000):
            c, line = np.asarray(table["c"]), np.asarray(table["line"])
            key = np.asarray(table["bands"].combine_chunks().flatten()).reshape(-1, bands_n)
            size, flat = gram_sets(table["grams"].combine_chunks())
            begin = np.cumsum(size) - size
            mark = np.zeros(int(flat.max(initial=-1)) + 1, np.int32)  # 1 for the grams of the line in turn
            root = np.arange(len(c))
            for b in range(bands_n):
                order = np.lexsort((key[:, b], c))
                turns = np.concatenate([[0], np.flatnonzero((np.diff(c[order]) != 0) | (np.diff(key[order, b]) != 0)) + 1, [len(c)]])
                for i in np.flatnonzero(np.diff(turns) > 1).tolist():
                    same = order[turns[i] : turns[i + 1]]
                    if (root[same] == root[same[0]]).all():
                        continue
                    for x, y in alike(same, root, size, begin, flat, mark, threshold):
                        u, v = sorted((root[x], root[y]))
                        if u < v:
                            root[root == v] = u
            keep = np.bincount(root, minlength=len(c))[root] > 1
            yield pa.RecordBatch.from_arrays([pa.array(line[keep]), pa.array(line[root][keep])], ["line", "cluster"])

    return run


def text_mark(text) -> F.Column:
    """64 bits of a text's hash, by which a text is known; texts of one mark and different text_check() are left alone."""
    return F.xxhash64(text)


def text_check(text) -> F.Column:
    """64 more bits, of another seed."""
    return F.xxhash64(F.lit(7), text)


def _side(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """df, a written table, to be broadcast in a join if it is small."""
    return F.broadcast(df) if small_side(df, limit) else df


def near_lines(texts: DataFrame, lines: DataFrame, threshold: float, least: int, shape: tuple[int, int], hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(line, cluster) of the lines (by hash) that are alike, of texts(d, t, text) and their lines(h, t, bands); and (line, grams) of these."""
    known = materialize(lines.groupBy(F.col("h").alias("line")).agg(*[F.max(F.col("bands")[k]).alias(f"b{k}") for k in range(shape[0])]))
    key = lambda k, b: (k.cast("long") * F.lit(1 << 32)) + F.col(b)
    posted = lambda part: known.select(F.explode(F.array(*[key(F.lit(k), f"b{k}") for k in range(part, shape[0], PARTS)])).alias("band"), "line")
    first = F.first("line").over(Window.partitionBy("band").orderBy("line"))
    edges = [materialize(posted(part).withColumn("first", first).where("line > first").select(F.col("line").alias("a"), F.col("first").alias("b"))) for part in range(min(PARTS, shape[0]))]
    candidates = components(reduce(DataFrame.union, edges)).select(F.col("node").alias("line"), F.col("component").alias("c"))
    for used in edges:
        discard(used)
    candidates = materialize(candidates.join(candidates.groupBy("c").agg(F.count("*").alias("n")), "c"))
    wanted = lines.select("t", F.col("h").alias("line")).join(_side(candidates).select("line"), "line").groupBy("line").agg(F.min("t").alias("t"))
    wanted = materialize(wanted.groupBy("t").agg(F.collect_list("line").alias("wanted")))  # of a text, its own lines
    about = texts.join(_side(wanted), "t").select("d", "t", "text", "wanted")
    grams = about.mapInArrow(eased(_emit_grams(least, shape)), "line bigint, grams array<bigint>, bands array<int>").dropDuplicates(["line"])
    grams = grams.join(_side(candidates), "line").select("line", "c", "n", "bands", "grams")
    big = not candidates.where(F.col("n") > hot).isEmpty()
    grams = materialize(grams)
    discard(known)
    discard(wanted)
    compare = lambda df: df.select("line", "c", "bands", "grams").repartition("c").sortWithinPartitions("c").mapInArrow(eased(_clusters(threshold, shape[0])), "line bigint, cluster bigint")
    out = compare(grams.where(F.col("n") <= hot))
    if big:
        by_band = grams.where(F.col("n") > hot).select("*", F.posexplode("bands").alias("k", "b")).withColumn("band", key(F.col("k"), "b"))
        sizes = materialize(by_band.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"))
        by_band = by_band.join(_side(sizes), "band").withColumn("blocks", F.ceil(F.col("m") / hot).cast("int"))
        by_band = by_band.withColumn("block", F.pmod(F.xxhash64("line"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        by_band = by_band.withColumn("c", F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))).withColumn("bands", F.array(*[F.when(F.col("k") == k, F.col("b")).otherwise(F.shiftright(F.xxhash64("line", F.lit(k)), 33).cast("int")) for k in range(shape[0])]))
        joined = compare(by_band).select(F.col("line").alias("a"), F.col("cluster").alias("b"))
        out = out.union(components(joined).select("node", "component"))
    return materialize(out), grams


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(d, t, s, e, kept): the spans to remove, by id, text hash and sign offsets, and the ids of the documents that keep what they hold."""
    ship(docs.sparkSession)
    shape_ = shape(threshold)
    named = docs.where(col(text).isNotNull()).select(col(doc_id).alias("d"), text_mark(col(text)).alias("t"), col(text).alias("text"))
    kind = named.schema["d"].dataType.simpleString()
    order = (F.col("d").isNull().alias("none"), "d", "t", "s", "e")
    place = f"d {kind}, t bigint, s int, e int"

    # of equal texts, the one of the least id is looked at; the others repeat it as a whole
    check = text_check(F.col("text"))
    same = named.groupBy("t").agg(F.min("d").alias("first"), F.min(F.xxhash64("d")).alias("a"), F.max(F.xxhash64("d")).alias("z"), (F.min(check) < F.max(check)).alias("twins"))
    same = materialize(same.where("a < z or twins").select("t", "first", "twins"))
    marked = named.join(_side(same).withColumn("many", F.lit(True)), "t", "left").where("not coalesce(twins, false)")
    first = F.col("many").isNull() | F.col("d").eqNullSafe(F.col("first"))
    texts = marked.where(first).select("d", "t", "text")
    whole = marked.where(~first).select("d", "t", "text", "first").mapInArrow(eased(_emit_whole(least)), f"{place}, first {kind}")
    whole = whole.select("d", "t", "s", "e", F.array("first").alias("kept"))

    # lines, alike by MinHash
    lines = materialize(texts.mapInArrow(eased(_emit_lines(least, shape_)), f"h bigint, {place}, bands array<int>"))
    clusters, grams = near_lines(texts, lines, threshold, least, shape_, hot)
    alike = lines.join(_side(clusters.withColumnRenamed("line", "h")), "h").select("cluster", "h", "d", "t", "s", "e")
    firsts = materialize(alike.groupBy("cluster").agg(F.min(F.struct(*order, "h")).alias("o")))
    other = ~((F.col("t") == F.col("o.t")) & (F.col("s") == F.col("o.s")) & (F.col("e") == F.col("o.e")))
    near = materialize(alike.join(_side(firsts), "cluster").where(other).select("h", "d", "t", "s", "e", F.col("o.d").alias("kd"), F.col("o.h").alias("head")))
    pairs = materialize(near.where("h <> head").select(F.col("h").alias("line"), "head").distinct())
    heads = materialize(pairs.select("head").distinct())
    own, first_ = grams.select("line", "grams"), grams.select(F.col("line").alias("head"), F.col("grams").alias("first")).join(_side(heads), "head", "left_semi")
    novel = own.join(_side(pairs), "line").join(first_, "head").select("line", "head", "grams", "first").mapInArrow(eased(_novel), "line bigint, head bigint, a int, z int")
    novel = materialize(novel.groupBy(F.col("line").alias("h"), "head").agg(F.collect_list(F.struct("a", "z")).alias("novel")))  # of a line, its own runs
    lost = near.join(_side(novel), ["h", "head"], "left").select("t", "s", "e", "kd", F.lit(False).alias("head"), "novel")
    stay = firsts.select("o.t", "o.s", "o.e", F.lit(None).cast(kind).alias("kd"), F.lit(True).alias("head"), F.lit(None).cast(novel.schema["novel"].dataType).alias("novel"))
    lost = lost.union(stay).groupBy("t").agg(F.collect_list(F.struct("s", "e", "kd", "head", "novel")).alias("lost")).where(F.exists("lost", lambda x: ~x["head"]))
    lost = materialize(lost)  # of a text, its own spans
    masked = texts.join(_side(lost), "t").select("d", "t", "text", "lost").mapInArrow(eased(_mask), f"d {kind}, t bigint, text string, gone array<struct<s:int,e:int,kd:{kind}>>")
    masked = materialize(masked)
    marks = materialize(masked.select("t"))
    for used in (lines, clusters, grams, near, firsts, pairs, heads, novel, lost):
        discard(used)
    texts = texts.join(_side(marks, FEW), "t", "left_anti").select("d", "t", "text").union(masked.select("d", "t", "text"))

    # windows near one that has its like
    picks = materialize(texts.mapInArrow(eased(_emit_picks), f"h bigint, d {kind}, t bigint, at int, role int"))
    spot = F.xxhash64("t", "at")
    parts = [picks.where(F.pmod("h", F.lit(PARTS)) == part) for part in range(PARTS)]
    met = [materialize(some.groupBy("h").agg(F.min(spot).alias("a"), F.max(spot).alias("z"), F.min("d").alias("head")).where("a < z").select("h", F.xxhash64("head").alias("head"))) for some in parts]
    found = [materialize(some.join(_side(of), "h").select("t", "at", "role", "head")) for some, of in zip(parts, met, strict=True)]
    shared = materialize(reduce(DataFrame.union, found).groupBy("t").agg(F.collect_set(F.struct("at", "role", "head")).alias("shared")))  # of a text, its own words
    sharing = materialize(shared.select("t"))
    for used in (picks, *met, *found):
        discard(used)
    about = texts.join(_side(sharing, FEW), "t", "left_semi").join(_side(shared), "t").select("d", "t", "text", "shared")
    rest = texts.join(_side(sharing, FEW), "t", "left_anti").select("d", "t", "text")

    # these, sentence runs and whole lines, equal in all their words
    runs = rest.mapInArrow(eased(_emit_pieces(least)), f"h bigint, h2 int, {place}").union(about.mapInArrow(eased(_emit_near(least)), f"h bigint, h2 int, {place}"))
    of = Window.partitionBy("h", "h2").orderBy(*order)  # places are sorted on disk, and none is held but the first
    gone = runs.withColumn("o", F.first(F.struct("d", "t", "s", "e")).over(of)).where(other).select("d", "t", "s", "e", F.col("o.d").alias("kd"))
    gone = materialize(gone.union(masked.select("d", "t", F.explode("gone").alias("x")).select("d", "t", "x.*")))
    for used in (masked, marks, shared, sharing):
        discard(used)
    by_text = gone.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e", "kd")).alias("events"))
    settled = materialize(by_text.mapInArrow(eased(_settle), f"{place}, kept array<{kind}>"))
    discard(gone)
    return settled.union(whole)


def _emit_whole(least: int):
    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                p = Paragraphs(b.column(2))
                first, last = p.texts(least)
                s, e = p.place(first, last)
                at = pa.array(p.doc[first])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s), pa.array(e), b.column(3).take(at)], ["d", "t", "s", "e", "first"])

    return run


def settle(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one text merged where they touch."""
    o = np.argsort(s, kind="stable")
    s, most = s[o], np.maximum.accumulate(e[o])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > most[:-1]]))
    return s[new], most[np.append(new[1:], len(s)) - 1]


def _settle(batches):
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        if not len(flat):
            continue
        s, e = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
        code = pc.dictionary_encode(flat.field(2), null_encoding="encode")
        sort = pc.array_sort_indices(code.dictionary)
        by_value = np.argsort(np.asarray(sort))  # rank of each code
        rank, offs = by_value[np.asarray(code.indices)], np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
        sorted_values = code.dictionary.take(sort)
        row, starts, ends, kept, counts = [], [], [], [], []
        for i in range(batch.num_rows):
            a, z = offs[i], offs[i + 1]
            lo, hi = settle(s[a:z], e[a:z])
            pair = np.unique(np.stack([np.searchsorted(lo, s[a:z], side="right") - 1, rank[a:z]]), axis=1)
            row.append(np.full(len(lo), i))
            starts.append(lo)
            ends.append(hi)
            kept.append(pair[1])
            counts.append(np.bincount(pair[0], minlength=len(lo)))
        if row:
            at = pa.array(np.concatenate(row))
            counts = np.concatenate(counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            values = sorted_values.take(pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32)), pa.ListArray.from_arrays(offsets, values)], ["d", "t", "s", "e", "kept"])


def substring_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(doc_id, start, end, kept_in): the spans of each document that repeat what the documents kept_in (the null id among them) keep."""
    out = repeats(docs, doc_id, text, threshold, least)
    return out.select(F.col("d").alias("doc_id"), F.col("s").alias("start"), F.col("e").alias("end"), F.col("kept").alias("kept_in"))


def _cut(width: int, at_text: int):
    """Columns c0 to those of the table, the text's cut by the spans in the column after them."""
    text = f"c{at_text}"

    def run(batches):
        for batch in batches:
            for b in blocks(batch, text):
                data, offs = raw(b.column(at_text))
                lead = (data & 0xC0) != 0x80
                sign = np.concatenate([[0], np.cumsum(lead)])
                lists = b.column(width)
                n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                pair = lists.flatten()
                row = np.repeat(np.arange(b.num_rows), n)
                lo = np.asarray(pair.field(0)).astype(np.int64) + sign[offs[row]] if len(pair) else np.zeros(0, np.int64)
                hi = np.asarray(pair.field(1)).astype(np.int64) + sign[offs[row]] if len(pair) else np.zeros(0, np.int64)
                drop = np.zeros(len(lead) + 1, np.int64)
                at = np.append(np.flatnonzero(lead), len(data))
                np.add.at(drop, at[lo], 1)
                np.add.at(drop, at[hi], -1)
                keep = np.cumsum(drop)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[offs]
                out = list(b.columns[:width])
                out[at_text] = put_strings(data[keep], kept, text_nulls(b, text))
                yield pa.RecordBatch.from_arrays(out, b.schema.names[:width])

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """docs with the repeated spans cut out of their texts, and n_chars, if there is such a column, counted again. A document of which
    nothing but white space remains is dropped; one that held nothing before stays."""
    d, t, m, spans = free(docs, "__d", "__t", "__m", "__spans")
    found = materialize(repeats(docs, doc_id, text, threshold, least).groupBy(F.col("d").alias(d), F.col("t").alias(m)).agg(F.collect_list(F.struct("s", "e")).alias(spans)))
    joined = docs.withColumn(t, text_mark(col(text))).join(_side(found), col(doc_id).eqNullSafe(col(d)) & (col(t) == col(m)), "left")
    columns = [col(c) for c in docs.columns]
    plain = renamed(joined.where(col(spans).isNotNull()).select(*columns, col(spans)))
    cut = plain.mapInArrow(eased(_cut(len(columns), docs.columns.index(text))), plain.drop(plain.columns[-1]).schema).toDF(*docs.columns).where(col(text).rlike(r"\S"))
    if n_chars in docs.columns:
        cut = cut.withColumn(n_chars, F.length(col(text)).cast(docs.schema[n_chars].dataType))
    return joined.where(col(spans).isNull()).select(*columns).union(cut.select(*columns))
