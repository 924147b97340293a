"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks.

The kernel of two strings counts the four-letter subsequences they share, each weighed by
decay ** (letters and spaces skipped). Texts are read by code points: case is dropped, marks and digits are no
part of a word, and spaces between single letters go, so `i-d-i.o t`, `i d i o t` and `idxiot` all resemble `idiot`.
Sentences (runs of whole words of about 24 letters) are compared with landmarks, words and beginnings of words;
whitened, the kernel values are coordinates in which a linear machine is trained on labelled sentences.
Labels come per document: in each round the two sentences of a toxic document that score highest stand for it
(multiple instances); the highest ones of clean documents, and some drawn ones, are negatives.

Since every kernel value is a sum over subsequences, the trained machine is one weight per subsequence.
Scoring looks these weights up for each position and each pattern of gaps, for millions of letters at once; no
subsequence runs from one text into another. A document's score is that of its two worst sentences through a
sigmoid, which is fitted on documents the machine wasn't trained on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import text_pieces, text_runs
from .common import texts

#: Symbols: 0 for white space, 1 to 26 for a to z, the rest shared by all letters of other alphabets.
SYMBOLS = 40
#: Skipped characters before the second, third and fourth letter.
GAPS = tuple((a, b, c) for a in range(3) for b in range(3) for c in range(3) if a + b + c <= 3)
DECAY = 0.75
REACH = 3 + max(sum(g) for g in GAPS)
UNIT = 24
#: Letters that are scored at a time.
PIECE = 1 << 18
_SKIP = 255


@cache
def _symbol_table() -> np.ndarray:
    """The symbol of each code point up to 65535; characters that are neither letters nor white space are skipped."""
    table = np.full(1 << 16, _SKIP, np.uint8)
    for i in range(1 << 16):
        c = chr(i).lower()[:1]
        if chr(i).isspace():
            table[i] = 0
        elif c.isalpha():
            table[i] = ord(c) - 96 if "a" <= c <= "z" else 27 + (ord(c) * 0x9E3779B1 >> 7) % (SYMBOLS - 27)
    return table


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts with REACH zeros behind each, where each text begins and the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    symbol = _symbol_table()[np.minimum(points, (1 << 16) - 1)]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    keep = symbol != _SKIP
    symbol, row = symbol[keep], row[keep]

    def around(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the character before, and the one behind, has a flag; the text's edges count as flagged."""
        new = row[1:] != row[:-1]
        return np.concatenate([[True], flag[:-1] | new])[: len(flag)], np.concatenate([flag[1:] | new, [True]])[-len(flag) :] if len(flag) else flag

    before, _ = around(symbol == 0)
    keep = ~((symbol == 0) & before)
    symbol, row = symbol[keep], row[keep]
    before, behind = around(symbol == 0)
    alone = (symbol > 0) & before & behind
    before, behind = around(alone)
    keep = ~((symbol == 0) & before & behind)
    symbol, row = symbol[keep], row[keep]
    out = np.zeros(len(symbol) + REACH * (len(offsets) - 1), np.uint8)
    out[np.arange(len(symbol)) + row * REACH] = symbol
    return out, np.searchsorted(row, np.arange(len(offsets))) + np.arange(len(offsets)) * REACH


def units(symbol: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where sentences begin: at every text, then at the first word in each further UNIT characters."""
    starts = np.flatnonzero((symbol > 0) & np.concatenate([[True], symbol[:-1] == 0])[: len(symbol)])
    text = np.searchsorted(begins, starts, "right") - 1
    block = (starts - begins[text]) // UNIT
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (text[1:] != text[:-1])])[: len(starts)]
    return np.union1d(begins[:-1], starts[new])


def features(text: str) -> Counter:
    """Weights of the subsequences of one string."""
    raw = np.frombuffer(text.encode(), np.uint8)
    symbol, out = letters(raw, np.array([0, len(raw)]))[0], Counter()
    for i in range(len(symbol) - REACH):
        for a, b, c in GAPS:
            s = [int(symbol[i + k]) for k in (0, a + 1, a + b + 2, a + b + c + 3)]
            if all(s):
                out[((s[0] * SYMBOLS + s[1]) * SYMBOLS + s[2]) * SYMBOLS + s[3]] += DECAY ** (a + b + c)
    return out


@dataclass(frozen=True)
class ToxicModel:
    """A weight for each subsequence, and the sigmoid from a document's two worst sentences to a score."""

    weights: np.ndarray
    slopes: tuple[float, float] = (1.0, 0.0)
    shift: float = 0.0

    def at_positions(self, symbol: np.ndarray) -> np.ndarray:
        """What the subsequences that begin at each position add up to; long texts go piece by piece, each with what its last ones reach."""
        if len(symbol) > 2 * PIECE:
            return np.concatenate([self.at_positions(symbol[a : a + PIECE + REACH])[:PIECE] for a in range(0, len(symbol), PIECE)])
        n, total = max(0, len(symbol) - REACH), np.zeros(len(symbol), np.float32)
        code = symbol.astype(np.intp)
        low = [code[: len(code) - k - 1] * SYMBOLS + code[k + 1 :] for k in range(3)]  # pairs of letters, k skipped between
        high = [x[:n] * SYMBOLS**2 for x in low]
        for skipped in range(4):
            part = np.zeros(n, np.float32)
            for a, b, c in GAPS:
                if a + b + c == skipped:
                    part += self.weights[high[a] + low[c][a + b + 2 : a + b + 2 + n]]
            total[:n] += part * np.float32(DECAY**skipped)
        return total

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The two highest sentence scores of each text, a column each; 0 at least."""
        out = np.zeros((len(offsets) - 1, 2))
        runs, owner = text_runs(data, offsets)
        at = 0
        while at < len(owner):  # some hundred thousand bytes at a time
            end = max(at + 1, int(np.searchsorted(runs, runs[at] + (1 << 18), "right")) - 1)
            own = data[runs[at] : runs[end]]
            symbol, begins = letters(own, runs[at : end + 1] - runs[at])
            if len(symbol):
                starts = units(symbol, begins)
                scores = np.maximum(np.add.reduceat(self.at_positions(symbol), starts), 0)
                text = owner[at:end][np.searchsorted(begins, starts, "right") - 1]
                order = np.lexsort((-scores, text))
                text, scores = text[order], scores[order]
                first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
                second = first[np.concatenate([np.diff(first), [len(text) - first[-1]]]) > 1] + 1
                old = out[text[first]]  # of earlier runs of the same text
                new = np.zeros((len(first), 2))
                new[:, 0] = scores[first]
                new[np.searchsorted(first, second - 1), 1] = scores[second]
                out[text[first]] = np.sort(np.hstack([old, new]), axis=1)[:, :1:-1]
            at = end
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        first, second = self.worst(data, offsets).T
        return 1 / (1 + np.exp(-np.clip(first * self.slopes[0] + second * self.slopes[1] + self.shift, -50, 50)))


def _landmarks(toxic: list[str], clean: list[str], count: int) -> tuple[list[str], int]:
    """Words and beginnings of words that mark toxic documents, and how many; then usual words of clean ones.

    Of those that surely come more often in toxic documents, each next one is that which marks most documents
    that the ones before leave unmarked, so that insults of rarer languages have theirs too.
    """
    word = re.compile(r"[^\W\d_]{4,24}")

    def parts(text: str) -> set[str]:
        own = set(word.findall(text.lower()))
        return own | {w[:k] for w in own for k in (4, 5, 6, 8) if k < len(w)}

    held = [Counter(), Counter()]
    for docs, counter in zip((toxic, clean), held):
        for d in docs:
            counter.update(parts(d))
    a, b = len(toxic), len(clean)
    sure = {}
    for w, n in held[0].items():
        all_share = (n + held[1][w] + 1) / (a + b + 2)
        surety = (n / a - held[1][w] / b) / np.sqrt(all_share * (1 - all_share) * (1 / a + 1 / b))
        if surety > 2.5:
            sure[w] = held[1][w] / b * a
    column = {w: i for i, w in enumerate(sorted(sure))}
    names, cost = sorted(sure), np.array([sure[w] for w in sorted(sure)])
    there = np.zeros((a, len(names)), bool)
    for row, d in zip(there, toxic):
        row[[column[w] for w in parts(d) if w in column]] = True
    left, marks = np.ones(a), []
    gain = lambda: left @ there - cost
    while len(marks) < min(count // 2, len(names)) and (best := gain()).max() > 0.5:
        k = int(best.argmax())
        marks.append(names[k])
        left[there[:, k]] *= 0.6
        cost[k] = np.inf
    full = Counter(w for d in clean for w in set(word.findall(d.lower())))
    usual = [w for w in sorted(full, key=lambda w: (-full[w], w)) if w not in marks]
    return [*marks, *usual[: count - len(marks)]], len(marks)


def _support_vector(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, passes: int = 25, seed: int = 5) -> np.ndarray:
    """Linear machine with weighted hinge loss; the last column of x is constant. Averaged subgradient steps."""
    rng = np.random.default_rng(seed)
    lam = 1.0 / (cost * len(y))
    share = weight / weight.mean()
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(passes):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(order) // 128)):
            t += 1
            rate = 1.0 / (lam * (t + 1.0 / lam))
            inside = y[at] * (x[at] @ w) < 1
            w = (1 - rate * lam) * w + rate * ((share[at] * y[at] * inside) @ x[at]) / len(at)
            mean += (w - mean) * (2.0 / (t + 1))
    return mean


def _joined(documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [d.encode() for d in documents]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _letters_of(documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all documents as letters() gives them, some documents at a time."""
    symbols, begins, total = [], [], 0
    for a in range(0, len(documents), 50):
        symbol, begin = letters(*_joined(documents[a : a + 50]))
        symbols.append(symbol)
        begins.append(begin[:-1] + total)
        total += len(symbol)
    return np.concatenate([np.zeros(0, np.uint8), *symbols]), np.concatenate([*begins, [total]]).astype(np.int64)


class _Sentences:
    """All sentences of some documents, and those of the highest scores."""

    def __init__(self, documents: list[str], drawn: int, seed: int):
        self.symbol, self.begins = _letters_of(documents)
        self.starts = units(self.symbol, self.begins)
        self.text = np.searchsorted(self.begins, self.starts, "right") - 1
        self.ends = np.append(self.starts[1:], len(self.symbol))
        draw = np.random.default_rng(seed).random(len(self.starts))
        self.drawn = self._top(draw, drawn)

    def _top(self, value: np.ndarray, count: int) -> np.ndarray:
        order = np.lexsort((-value, self.text))
        rank = np.arange(len(order)) - np.searchsorted(self.text[order], self.text[order])
        return np.sort(order[rank < count])

    def highest(self, model: ToxicModel, count: int) -> np.ndarray:
        return self._top(np.add.reduceat(model.at_positions(self.symbol), self.starts), count)

    def kernel(self, chosen: np.ndarray, column: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Kernel values of chosen sentences with all landmarks; a row of `marks` per landmark."""
        out, by_id = np.zeros((len(chosen), len(marks)), np.float32), np.ascontiguousarray(marks.T)
        for a in range(0, len(chosen), 100):
            some = chosen[a : a + 100]
            size = self.ends[some] - self.starts[some]
            row = np.repeat(np.arange(len(some)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[some], size)
            ahead = np.minimum(place[:, None] + np.arange(REACH + 1), len(self.symbol) - 1)
            letter = self.symbol[ahead].astype(np.int32)
            rows, ids, parts = [], [], []
            for gap in GAPS:
                b, c, d = gap[0] + 1, gap[0] + gap[1] + 2, sum(gap) + 3
                at = column[((letter[:, 0] * SYMBOLS + letter[:, b]) * SYMBOLS + letter[:, c]) * SYMBOLS + letter[:, d]]
                rows.append(row[at >= 0])
                ids.append(at[at >= 0])
                parts.append(np.full(len(ids[-1]), DECAY ** sum(gap), np.float32))
            rows, ids, parts = np.concatenate(rows), np.concatenate(ids), np.concatenate(parts)
            order = np.argsort(rows, kind="stable")
            if len(order):
                first = np.flatnonzero(np.diff(rows[order], prepend=-1))
                out[a + rows[order][first]] = np.add.reduceat(by_id[ids[order]] * parts[order, None], first, axis=0)
        return out


def fit(documents: list[tuple[str, int]], share: float | None = None, landmarks: int = 160, rounds: int = 3, cost: float = 10.0) -> ToxicModel:
    """Train on (text, label) documents; `share` is that of label 1 where they come from.

    A quarter of the documents, by a hash of the text, is left out of training and fits the sigmoid. Toxic documents
    are learnt as they are and spoiled.
    With one label only, the model gives that label's share everywhere.
    """
    documents = [(t or "", int(label == 1)) for t, label in documents]
    apart = [zlib.crc32(t.encode()) % 4 == 0 for t, _ in documents]
    if len({x for (_, x), left in zip(documents, apart) if left}) < 2 or len({x for (_, x), left in zip(documents, apart) if not left}) < 2:
        apart = [False] * len(documents)
    train = [d for d, left in zip(documents, apart) if not left]
    held = [d for d, left in zip(documents, apart) if left] or train
    toxic, clean = ([t for t, label in train if label == want and t.strip()] for want in (1, 0))
    table = np.zeros(SYMBOLS**4, np.float32)
    own = sum(label for _, label in documents) / max(1, len(documents))
    share = own if share is None else share
    if not toxic or not clean:
        return ToxicModel(table, (0.0, 0.0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    words, sure = _landmarks(toxic, clean, landmarks)
    marks = [m for m in (features(w) for w in words) if m]
    ids = np.unique(np.concatenate([np.fromiter(m, np.int64) for m in marks])) if marks else np.zeros(0, np.int64)
    if not len(ids):
        return ToxicModel(table, (0.0, 0.0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    matrix = np.zeros((len(marks), len(ids)), np.float32)
    for row, m in zip(matrix, marks):
        row[np.searchsorted(ids, np.fromiter(m, np.int64))] = np.fromiter(m.values(), float)
        row /= max(1e-9, np.sqrt((row**2).sum()))
    values, vectors = np.linalg.eigh((matrix @ matrix.T).astype(float))
    keep = values > 1e-6 * values[-1]
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    column = np.full(SYMBOLS**4, -1, np.int32)
    column[ids] = np.arange(len(ids))
    pos, neg = _Sentences(toxic + [spoiled(t, i) for i, t in enumerate(toxic)], 0, 1), _Sentences(clean, 10, 2)
    coordinates = lambda s, at: np.hstack([s.kernel(at, column, matrix) @ whiten, np.ones((len(at), 1), np.float32)])
    table[ids] = matrix[: max(1, sure)].sum(0)
    hard = neg.drawn
    for _ in range(rounds):
        model = ToxicModel(table)
        chosen, hard = pos.highest(model, 2), np.union1d(hard, neg.highest(model, 3))
        x = np.vstack([coordinates(pos, chosen), coordinates(neg, hard)])
        y = np.repeat([1.0, -1.0], [len(chosen), len(hard)])
        w = _support_vector(x, y, np.where(y > 0, len(hard) / len(chosen) / 2, 1.0), cost)
        table = np.zeros(SYMBOLS**4, np.float32)
        table[ids] = matrix.T @ (whiten @ w[:-1].astype(np.float32))
    return _calibrated(ToxicModel(table), held, share)


def spoiled(text: str, seed: int) -> str:
    """The text with a letter or a mark put into each word of five letters or more, as one does to hide an insult."""
    rng = np.random.default_rng(seed)

    def change(m: re.Match) -> str:
        w, k = m[0], int(rng.integers(1, len(m[0])))
        return w[:k] + ".-*xo"[int(rng.integers(5))] + w[k:]

    return re.sub(r"[^\W\d_]{5,}", change, text)


def _calibrated(model: ToxicModel, documents: list[tuple[str, int]], share: float) -> ToxicModel:
    """Fit the sigmoid by Newton steps, labels weighed to the share they have where the documents come from; every
    document counts as it is and spoiled."""
    label = np.array([float(b) for _, b in documents] * 2)
    raw = model.worst(*_joined([t for t, _ in documents] + [spoiled(t, i) for i, (t, _) in enumerate(documents)]))
    scale = max(1e-9, float(np.median(raw[label == 1, 0])) if (label == 1).any() else 1.0)
    x = np.column_stack([raw / scale, np.ones(len(raw))])
    weight = np.where(label == 1, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum())) * len(label)
    beta, ridge = np.array([1.0, 1.0, -1.0]), np.array([1e-2, 1e-2, 1e-4])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - label)) + ridge * beta
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(ridge), grad)
        beta = beta - np.clip(step, -1, 1)
    slopes = np.maximum(beta[:2], 1e-3) / scale
    return ToxicModel(model.weights, (float(slopes[0]), float(slopes[1])), float(beta[2]))


def training_documents(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, most_bytes: int = 20_000) -> tuple[DataFrame, float]:
    """(toxic, doc_id, text) of labelled documents outside the held-out fold, whole, at most so many of either label (those of lowest
    hashed id, less any over most_bytes long), and the share of label 1 among all of that kind. The sample takes
    most_bytes * (most_toxic + most_clean) at most, whatever the size of the tables."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where((fold != 1) & F.col("toxic").isin(0, 1))
    share = marks.agg(F.avg("toxic")).first()[0]
    picked = [marks.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v, most in ((1, most_toxic), (0, most_clean))]
    rows = texts(docs).join(F.broadcast(picked[0].union(picked[1])), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes)
    return rows.select("toxic", "doc_id", "text"), share or 0.0


def trained(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> ToxicModel:
    """The model that fit() gives for the training documents. They meet in one task, being bounded; of them only the weights come to the driver."""
    rows, share = training_documents(docs, labels, most_toxic, most_clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([(t or "", label) for batch in batches for t, label in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())], share)
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (at.astype("<i4").tobytes(), model.weights[at].astype("<f4").tobytes(), *model.slopes, model.shift)], ["at", "weights", "first", "second", "shift"])

    one = rows.repartition(1).sortWithinPartitions("toxic", "doc_id", "text").select("toxic", "text")
    found = one.mapInArrow(run, "at binary, weights binary, first double, second double, shift double").collect()
    if not found:  # no row, no task
        return fit([], share)
    weights = np.zeros(SYMBOLS**4, np.float32)
    weights[np.frombuffer(found[0]["at"], "<i4")] = np.frombuffer(found[0]["weights"], "<f4")
    return ToxicModel(weights, (found[0]["first"], found[0]["second"]), found[0]["shift"])


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score of every document; a null text scores as an empty one. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(data, offsets) for _, _, data, offsets in text_pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most_toxic: int = 800, most_clean: int = 800, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on) for every document.

    Learns from at most most_toxic and most_clean documents of the labels outside the held-out fold. Without labelled
    documents of both labels every score is the known label's share. A text's score depends on that text alone; null texts
    score as empty ones, repeated rows alike. Texts of over a megabyte are read in runs of whole words. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    model = trained(docs, labels, most_toxic, most_clean)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, most_toxic: int = 800, most_clean: int = 800, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with all their columns; trained as in `toxicity`."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, most_toxic, most_clean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(data, offsets) for _, _, data, offsets in text_pieces(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(scores) < threshold if scores else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
