"""Operator 1: byte-level BPE encoding and decoding by merge replay.

The merges of a public byte-level vocabulary are replayed, in rank order, over the distinct words of a slice of the corpus at once:
an inverted index maps each token pair to the positions where it occurs, a merge rewrites all its positions together, and only the
pairs of the touched neighbours enter the index again. A new pair always ranks after the merge that made it, so one ascending sweep
does for every word what merging it alone by lowest rank does. The slices are the partitions' own texts: each distinct word is encoded
once a slice, nothing is shuffled and no dictionary is broadcast that grows with the corpus.

Defined results: a null text gives null tokens, null count and null decoded text; an empty text gives no tokens and "". Repeated rows
are encoded alike, each in its own row. Other columns pass through untouched, unless they are named like an output, which replaces them.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.llm.textblock import MULT, blocks, col, eased, put_lists, put_strings, raw, renamed, span_hash, text_nulls
from quarrylens.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CHUNK = 8 << 20
SLOT_BITS = 19
WORDS_KEPT = 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 white space, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (2, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = 3
    return out


def split_words(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens start, for the usual byte-level pattern: contractions, runs of letters, of numbers or of other
    signs with a space before them, and white space. The pre-tokens tile each text."""
    if not len(data):
        return np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    cls = classes()[cp]
    doc = np.zeros(n + 1, bool)
    doc[np.searchsorted(lead, offs)] = True
    st = np.empty(n + 3, bool)
    st[n:] = True
    st[0] = True
    st[1:n] = (cls[1:] != cls[:-1]) | doc[1:n]
    run_start = st[:n].copy()
    # white space before something else in the same text: its last sign joins what follows if it is a space, or stands alone
    b = np.flatnonzero(run_start[1:] & ~doc[1:n] & (cls[:-1] == 2)) + 1
    st[b - 1] = True
    st[b[cp[b - 1] == 0x20]] = False
    # contractions, where a single apostrophe starts a pre-token
    i = np.flatnonzero(st[:n] & run_start & (cp == 0x27))
    i = i[i + 1 < n]
    i = i[run_start[i + 1] & ~doc[i + 1] & (cls[i + 1] == 0)]
    if len(i):
        c1 = cp[i + 1]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        far = np.minimum(i + 2, n - 1)
        c2 = np.where((i + 2 < n) & ~doc[far] & (cls[far] == 0), cp[far], 0)
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        st[i[one | two] + 1] = False
        st[i[one] + 2] = True
        st[i[two] + 3] = True
    return lead[np.flatnonzero(st[:n])]


class Merges:
    """A vocabulary: the bytes of each token and its merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(keep))}
        back = {c: b for b, c in signs.items()}
        ids = model["vocab"]
        self.size = max(ids.values()) + 1
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.lens = np.array([len(p) for p in pieces], np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.at = np.cumsum(self.lens) - self.lens
        self.byte_id = np.array([ids[signs[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.new = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left * self.size + self.right
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_rank = np.full(1 << SLOT_BITS, -1, np.int64)
        for rank, (k, i) in enumerate(zip(keys.tolist(), self.slot(keys).tolist(), strict=True)):
            while self.slots[i] >= 0:
                i = (i + 1) & ((1 << SLOT_BITS) - 1)
            self.slots[i], self.slot_rank[i] = k, rank

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * MULT >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where there is no such merge."""
        k = a.astype(np.int64) * self.size + b
        i = self.slot(k)
        there = self.slots[i]
        out = np.where(there == k, self.slot_rank[i], -1)
        left = np.flatnonzero((there != k) & (there >= 0))
        i = i[left]
        while len(left):
            i = (i + 1) & ((1 << SLOT_BITS) - 1)
            there = self.slots[i]
            hit = there == k[left]
            out[left[hit]] = self.slot_rank[i[hit]]
            on = ~hit & (there >= 0)
            left, i = left[on], i[on]
        return out

    def replay(self, data: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words laid end to end in data: flat ids and how many each word has."""
        n = len(data)
        sym = self.byte_id[data].astype(np.int32)
        ends = np.cumsum(lens)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends - lens] = -1
        at = np.flatnonzero(nxt >= 0).astype(np.int32)
        r = self.ranks(sym[at], sym[at + 1])
        at, r = at[r >= 0], r[r >= 0]
        o = np.argsort(r, kind="stable")
        at, r = at[o], r[o]
        active, first = np.unique(r, return_index=True)
        initial = dict(zip(active.tolist(), np.split(at, first[1:]) if len(active) else [], strict=True))
        later: dict[int, list[int]] = defaultdict(list)
        heap = active.tolist()
        while heap:
            k = heapq.heappop(heap)
            new = later.pop(k, None)
            p = initial.pop(k, None)
            if p is None and new is None:
                continue
            if new is not None:
                new = np.unique(np.array(new, np.int32))
                p = new if p is None else np.union1d(p, new)
            a, b = self.left[k], self.right[k]
            q = nxt[p]
            ok = (sym[p] == a) & (q >= 0)
            ok[ok] = sym[q[ok]] == b
            p = p[ok]
            if a == b and len(p) > 1:  # aaa: from the left, without overlap
                kept, taken = [], -1
                for x, y in zip(p.tolist(), nxt[p].tolist(), strict=True):
                    if x != taken:
                        kept.append(x)
                        taken = y
                p = np.array(kept, np.int32)
            if not len(p):
                continue
            q = nxt[p]
            far = nxt[q]
            sym[p] = self.new[k]
            sym[q] = -1
            nxt[p] = far
            there = far >= 0
            prv[far[there]] = p[there]
            before = prv[p]
            left = before[before >= 0]
            right = p[there]
            touched = np.concatenate([left, right])
            if not len(touched):
                continue
            rank = self.ranks(sym[touched], sym[nxt[touched]])
            good = rank > k
            for x, y in zip(rank[good].tolist(), touched[good].tolist(), strict=True):
                if x not in later and x not in initial:
                    heapq.heappush(heap, x)
                later[x].append(y)
        live = sym >= 0
        word = np.repeat(np.arange(len(lens)), lens)
        return sym[live], np.bincount(word[live], minlength=len(lens))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of tokens laid end to end, and the length of each one's."""
        return gather(self.bytes, self.at, self.lens, ids)


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = lens[ids]
    start = np.cumsum(n) - n
    pos = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(at[ids] - start, n)
    return flat[pos], n


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


class Dictionary:
    """Tokens of the words met so far, by the words' hashes."""

    def __init__(self, m: Merges):
        self.m = m
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.ids, self.at, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def missing(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.ones(len(h), bool)
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return self.hash[i] != h

    def add(self, h: np.ndarray, data: np.ndarray, lens: np.ndarray) -> None:
        ids, n = self.m.replay(data, lens)
        row = len(self.lens) + np.arange(len(h))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.lens = np.concatenate([self.lens, n])
        self.ids = np.concatenate([self.ids, ids])
        both, rows = np.concatenate([self.hash, h]), np.concatenate([self.row, row])
        o = np.argsort(both, kind="stable")
        self.hash, self.row = both[o], rows[o]

    def tokens(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.ids, self.at, self.lens, self.row[np.searchsorted(self.hash, h)])


def encode_slice(parts: list[pa.RecordBatch], text: str, words: Dictionary) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, token ids, tokens a row, decoded bytes, their offsets) of each batch of a slice."""
    if len(words.lens) > WORDS_KEPT:
        words.clear()
    spans, fresh = [], {"h": [], "data": [], "lens": []}
    for b in parts:
        data, offs = raw(b.column(b.schema.get_field_index(text)))
        starts = split_words(data, offs)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        h = span_hash(data, starts, ends)
        spans.append((data, offs, starts, h))
        u, first = np.unique(h, return_index=True)
        new = words.missing(u)
        u, first = u[new], first[new]
        if len(u):
            got, lens = gather(data, starts, ends - starts, first)
            for k, v in (("h", u), ("data", got), ("lens", lens)):
                fresh[k].append(v)
    if fresh["h"]:
        h, lens, data = (np.concatenate(fresh[k]) for k in ("h", "lens", "data"))
        at = np.cumsum(lens) - lens
        u, first = np.unique(h, return_index=True)
        got, lens = gather(data, at, lens, first)
        words.add(u, got, lens)
    for b, (data, offs, starts, h) in zip(parts, spans, strict=True):
        ids, n = words.tokens(h) if len(h) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        per_row = np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)])
        got, size = words.m.decode(ids)
        if len(got) != len(data) or not np.array_equal(got, data):  # two words of one hash: the slice again, word by word
            lens = np.diff(np.append(starts, len(data)))
            ids, n = words.m.replay(data, lens)
            per_row = np.diff(np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offs)])
            got, size = words.m.decode(ids)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per_row)])]
        yield b, ids, per_row, got, ends


def _null_rows(col: pa.Array, null: np.ndarray) -> pa.Array:
    if not null.any():
        return col
    import pyarrow.compute as pc

    return pc.if_else(pa.array(~null), col, pa.scalar(None, col.type))


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", decoded: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with tokens array<int>, n_tokens long and, if asked, decoded string: the text that the tokens decode to."""
    ship(docs.sparkSession)
    extra = [T.StructField("tokens", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decoded
    names = {f.name for f in extra}
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    columns = [f.name for f in kept]
    need = list(dict.fromkeys([*columns, text]))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)] + extra)
    body = f"c{need.index(text)}"

    def run(batches):
        words = Dictionary(merges(vocabulary))

        def flush(parts):
            for b, ids, n, got, ends in encode_slice(parts, body, words):
                null = text_nulls(b, body)
                out = list(b.columns[: len(columns)])
                out += [_null_rows(put_lists(ids, n, pa.int32()), null), _null_rows(pa.array(n, pa.int64()), null)]
                out += [put_strings(got, ends, null)] * decoded
                yield pa.RecordBatch.from_arrays(out, schema.names)

        held, size = [], 0
        for batch in batches:
            for b in blocks(batch, body):
                held.append(b)
                size += raw(b.column(b.schema.get_field_index(body)))[1][-1]
                if size >= CHUNK:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return renamed(docs.select(*[col(c) for c in need])).mapInArrow(eased(run), schema).toDF(*columns, *(f.name for f in extra))


def bpe_decode(df: DataFrame, vocabulary: str = VOCABULARY, tokens: str = "tokens", to: str = "decoded") -> DataFrame:
    """df with the text of its token ids. Null tokens give null; ids outside the vocabulary raise; bytes that are no UTF-8 become U+FFFD."""
    ship(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != to] + [T.StructField(to, T.StringType())])
    columns = [f.name for f in schema.fields[:-1]]

    def run(batches):
        m = merges(vocabulary)
        for b in batches:
            col = b.column(b.schema.get_field_index(tokens))
            flat = np.asarray(col.flatten()).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= m.size):
                raise ValueError("token id outside the vocabulary")
            import pyarrow.compute as pc

            n = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
            got, size = m.decode(flat)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            try:
                got.tobytes().decode()
                texts = put_strings(got, ends)
            except UnicodeDecodeError:
                texts = pa.array([got[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            texts = _null_rows(texts, np.asarray(pc.is_null(col), bool))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in columns), texts], [*columns, to])

    return df.mapInArrow(eased(run), schema)
