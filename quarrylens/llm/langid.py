"""Operator 2: language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; what is trained here is, for each language, the probability of each piece, by a few
rounds of expectation maximisation over the words of a bounded labelled sample. A word's probability in a language is the sum over all
its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Words are scored once a partition, a
length at a time and for all languages together, and a text's score is a grouped sum, so that no text passes through a Python loop.

A document is accepted if its best language gives its signs a higher mean probability than a uniform choice among 256 signs would.
Only words with a letter and without a digit count: numbers, codes and signs tell of no language.
Defined results: a null, empty or blank text, or one without such a word, has no language, null score and margin, and is rejected. Ties go to the language first in
alphabetical order. Where no labelled row exists, nothing has a language and all is rejected. A sign in no piece costs UNKNOWN. Words
of any length are summed over all their segmentations; those of more than LONGEST signs step by step in scaled numbers, many side by side. For
the fit alone, on its bounded sample, they are cut into fragments of LONGEST. Repeated rows get the same result. Columns that are kept pass
through, whatever their names, unless they have the name of a new one. The model is pieces x languages: as large as the vocabulary and the
set of labels, which must be of languages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.textblock import Lookup, blocks, col, eased, raw, renamed, span_hash, word_spans
from quarrylens.llm.bpe import gather
from quarrylens.runtime import ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 200  # labelled documents a language, about
ROUNDS = 3
LONGEST = 32
UNKNOWN = math.exp(-12.0)
FLOOR = -math.log(256.0)
MARK = 0x2581
KIND = np.zeros(256, np.uint8)  # of each byte: 1 of a letter or a sign outside ASCII, 2 a digit
KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2
BLOCK = 2 << 20  # bytes of text that are taken at once
CELLS = 1 << 18  # signs of words that are scored at once
KEPT = 1 << 21  # scores (words x languages) that a partition remembers


@dataclass
class PieceModel:
    """Piece probabilities by language: prob has a row for the unknown sign (0), one for each piece and a last one of zeros; trie leads
    from (node, sign) to the next node, and row from a node to its piece's row of prob, or the last."""

    languages: list[str]
    trie: Lookup
    row: np.ndarray
    size: int
    prob: np.ndarray  # (2 + pieces, languages)

    def lookup(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """chars: words of one length, a column each. Of each piece length, where pieces begin: place, word, row of prob; by place."""
        m, n = chars.shape
        flat = chars.ravel().astype(np.int64)
        at = np.arange(m * n)
        node = np.zeros(m * n, np.int64)
        out = [(at[:0], at[:0], at[:0])]
        for size in range(1, min(m, self.size) + 1):
            node = self.trie.get(node << 21 | flat[at + (size - 1) * n])
            row = self.row[node]  # of node -1, the last
            if size == 1:
                row = np.where(row == len(self.prob) - 1, 0, row)
            hit = row < len(self.prob) - 1
            out.append((at[hit] // n, at[hit] % n, row[hit]))
            on = (node >= 0) & (at < (m - size) * n)
            at, node = at[on], node[on]
        return out

    def forward(self, found: list, m: int, n: int, back: bool = False) -> np.ndarray:
        """[j]: summed probability of all segmentations of the first j signs (back: of all signs from the j-th), (m + 1, languages, words)."""
        width = self.prob.shape[1]
        columns = np.ascontiguousarray(self.prob.T)
        alpha = np.zeros((m + 1, width, n))
        alpha[m if back else 0] = 1.0
        cuts = [np.searchsorted(place, np.arange(m + 1)) for place, _, _ in found]
        for j in range(m - 1, -1, -1) if back else range(1, m + 1):
            for size in range(1, min(m - j if back else j, len(found) - 1) + 1):
                i = j if back else j - size
                a, b = cuts[size][i], cuts[size][i + 1]
                if a == b:
                    continue
                _, word, row = (x[a:b] for x in found[size])
                other = alpha[j + size if back else i]
                if b - a == n:
                    for k in range(width):
                        alpha[j, k] += other[k] * columns[k][row]
                else:
                    for k in range(width):
                        alpha[j, k, word] += other[k, word] * columns[k][row]
        return alpha

    def score(self, chars: np.ndarray) -> np.ndarray:
        """Log probabilities (words, languages) of words of one length."""
        m, n = chars.shape
        return np.log(self.forward(self.lookup(chars), m, n)[m]).T

    def expect(self, chars: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, as prob, for words with weights (languages, words)."""
        m, n = chars.shape
        found = self.lookup(chars)
        alpha, beta = self.forward(found, m, n), self.forward(found, m, n, back=True)
        share = weight / alpha[m]
        out = np.zeros_like(self.prob)
        for size in range(1, len(found)):
            place, word, row = found[size]
            for k in range(self.prob.shape[1]):
                out[:, k] += np.bincount(row, alpha[place, k, word] * self.prob[row, k] * beta[place + size, k, word] * share[k, word], len(out))
        return out


def char_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of byte spans laid end to end, each after a word mark; where each begins; its length with the mark."""
    got, size = gather(data, starts, ends - starts, np.arange(len(starts)))
    cp = np.frombuffer(got.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = ((got & 0xC0) != 0x80).astype(np.int64)
    first = np.cumsum(size) - size
    n = np.add.reduceat(lead, first) if len(first) else np.zeros(0, np.int64)
    at = np.cumsum(n) - n
    out = np.insert(cp, at, MARK)
    return out, at + np.arange(len(at)), n + 1


def long_scores(model: PieceModel, chars: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Log probabilities (words, languages) of words of any lengths, a column each, filled up below: the forward sums of the last few places
    are kept, scaled after each step, and the scales' logarithms are added up."""
    m, n = chars.shape
    found = model.lookup(chars)
    width, depth = model.prob.shape[1], len(found) - 1
    window = np.zeros((depth, n, width))  # [0]: the place before
    window[0] = 1.0
    logs, out = np.zeros((n, width)), np.zeros((n, width))
    step = max(1, (1 << 21) // (depth * n * width))
    for base in range(0, m, step):
        stop = min(base + step, m)
        weight = np.zeros((stop - base, depth, n, width))  # of the pieces that end behind each place
        for size in range(1, depth + 1):
            place, word, row = found[size]
            a, z = np.searchsorted(place, [base + 1 - size, stop + 1 - size])
            weight[place[a:z] + size - 1 - base, size - 1, word[a:z]] = model.prob[row[a:z]]
        for j in range(base, stop):
            new = (window * weight[j - base]).sum(0)
            window[1:] = window[:-1]
            window[0] = new
            window /= new
            logs += np.log(new)
            done = lens == j + 1
            if done.any():
                out[done] = logs[done]
    return out


def word_scores(model: PieceModel, cps: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Log probabilities (words, languages)."""
    out = np.zeros((len(at), len(model.languages)))
    for m in np.unique(lens[lens <= LONGEST]):
        w = np.flatnonzero(lens == m)
        step = max(1, CELLS // int(m))
        for c in range(0, len(w), step):
            part = w[c : c + step]
            out[part] = model.score(cps[at[part] + np.arange(m)[:, None]])
    far = np.flatnonzero(lens > LONGEST)
    far = far[np.argsort(lens[far], kind="stable")]
    c = 0
    while c < len(far):  # words of like lengths together
        longest = min(int(2 * lens[far[c]]), int(lens[far[-1]]))
        z = int(np.searchsorted(lens[far], longest, side="right"))
        part = far[c : min(z, c + max(1, (1 << 18) // longest))]
        rows = np.arange(lens[part].max())[:, None]
        chars = np.where(rows < lens[part], cps[np.minimum(at[part] + rows, len(cps) - 1)], 0)
        out[part] = long_scores(model, chars, lens[part])
        c += len(part)
    return out


def untrained(path: str, languages: list[str]) -> PieceModel:
    """Equal probabilities for the pieces of a vocabulary."""
    import sentencepiece as sp

    p = sp.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    edges: dict[int, int] = {}
    row = [-1]
    for k, piece in enumerate(pieces):
        node = 0
        for c in piece:
            key = node << 21 | ord(c)
            node = edges.setdefault(key, len(row))
            if node == len(row):
                row.append(-1)
        row[node] = k + 1
    last = len(pieces) + 1
    rows = np.array([*row, -1], np.int64)
    prob = np.full((last + 1, len(languages)), 1.0 / last)
    prob[0], prob[last] = UNKNOWN, 0.0
    table = Lookup(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64))
    return PieceModel(languages, table, np.where(rows < 0, last, rows), max(map(len, pieces)), prob)


TELLING_WORD = r"w RLIKE '[^\\x00-\\x60\\x7b-\\x7f]' AND NOT w RLIKE '[0-9]'"  # as evidence() has it


def train_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE, rounds: int = ROUNDS, text: str = "text", lang: str = "lang") -> PieceModel:
    """Piece probabilities from about `sample` labelled documents a language, chosen by a hash of their text."""
    labelled = docs.where(col(lang).isNotNull() & (F.length(F.trim(col(text))) > 0)).select(col(lang).alias("lang"), col(text).alias("text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    model = untrained(vocabulary, languages)
    if not languages:
        return model
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 1.1 * sample / counts[k])))])
    chosen = labelled.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where(TELLING_WORD).groupBy("lang", "w").agg(F.count("*").alias("n")).toArrow()
    table = words.to_pandas().pivot_table(index="w", columns="lang", values="n", fill_value=0, aggfunc="sum").reindex(columns=languages, fill_value=0)
    marked = [chr(MARK) + w for w in table.index]
    pieces = [(w[k : k + LONGEST], j) for j, w in enumerate(marked) for k in range(0, len(w), LONGEST)]
    size = np.array([len(w) for w, _ in pieces])
    weight = table.to_numpy(float)[[j for _, j in pieces]] if pieces else np.zeros((0, len(languages)))
    groups = [(np.array([[ord(c) for c in pieces[i][0]] for i in np.flatnonzero(size == m)], np.uint32).T, weight[size == m].T) for m in np.unique(size)]
    for _ in range(rounds):
        got = sum((model.expect(chars, w) for chars, w in groups), np.zeros_like(model.prob))
        got[1:-1] += 0.02
        model.prob = got / got[1:-1].sum(0)
        model.prob[0], model.prob[-1] = UNKNOWN, 0.0
    return model


def identify(docs: DataFrame, model: PieceModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with lid string, lid_score (log probability a sign), lid_margin (to the second language, nats), lid_ok."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # pieces x languages: the vocabulary bounds it
    extra = [T.StructField("lid", T.StringType()), T.StructField("lid_score", T.DoubleType()), T.StructField("lid_margin", T.DoubleType()), T.StructField("lid_ok", T.BooleanType())]
    names = {f.name for f in extra}
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    columns = [f.name for f in kept]
    need = list(dict.fromkeys([*columns, text]))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)] + extra)
    body = f"c{need.index(text)}"

    def run(batches):
        m = shared.value
        known, table = np.zeros(0, np.uint64), np.zeros((0, max(1, len(m.languages))))
        for batch in batches:
            for b in blocks(batch, body, BLOCK):
                data, offs = raw(pc.utf8_lower(b.column(b.schema.get_field_index(body))))
                starts, ends, doc = evidence(data, *word_spans(data, offs))
                h = span_hash(data, starts, ends)
                u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                if table.size > KEPT:
                    known, table = known[:0], table[:0]
                i = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
                new = known[i] != u if len(known) else np.ones(len(u), bool)
                if new.any() and m.languages:
                    scores = word_scores(m, *char_rows(data, starts[first[new]], ends[first[new]]))
                    o = np.argsort(both := np.concatenate([known, u[new]]), kind="stable")
                    known, table = both[o], np.concatenate([table, scores])[o]
                n = b.num_rows
                signs = np.bincount(doc, weights=(ends - starts) + 1.0, minlength=n)
                signs -= np.bincount(doc, weights=_continuations(data, starts, ends), minlength=n)
                has = signs > 0
                lid, score, margin = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                if m.languages and len(u):
                    own = table[np.searchsorted(known, u)]
                    total = np.stack([np.bincount(doc, weights=own[inverse, k], minlength=n) for k in range(len(m.languages))], 1)
                    lid = total.argmax(1)
                    best = total.max(1)
                    second = np.partition(total, -2, 1)[:, -2] if total.shape[1] > 1 else best
                    score, margin = best / np.maximum(signs, 1), best - second
                else:
                    has = np.zeros(n, bool)
                null = pa.array(~has)
                out = list(b.columns[: len(columns)])
                out.append(pc.if_else(null, None, pa.array(np.array([*m.languages, ""], object)[np.where(has, lid, -1)], pa.string())))
                out.append(pc.if_else(null, None, pa.array(score)))
                out.append(pc.if_else(null, None, pa.array(margin)))
                out.append(pa.array(has & (score > FLOOR)))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return renamed(docs.select(*[col(c) for c in need])).mapInArrow(eased(run), schema).toDF(*columns, *(f.name for f in extra))


def evidence(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that tell of a language: those with a letter (or a sign outside ASCII) and without a digit."""
    if not len(starts):
        return starts, ends, doc
    good = np.bitwise_or.reduceat(KIND[np.append(data, np.uint8(0))], np.stack([starts, ends], 1).ravel())[::2] == 1
    return starts[good], ends[good], doc[good]


def _continuations(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of each span that only continue a sign."""
    c = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) == 0x80, out=c[1:])
    return (c[ends] - c[starts]).astype(float)
