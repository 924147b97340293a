"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of its hashed 1- to 4-byte subwords; a softmax over that average
gives the language. Both layers are trained together by stochastic gradient descent in numpy. As
both are linear, scoring adds up one row of class weights per subword over whole texts. A temperature
and a least confidence are then set on documents the training didn't see, so that of the answers that
stand, at most a stated share is wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesets import text_pieces
from .common import texts

BUCKETS = 1 << 13
SIZES = (1, 2, 3, 4)
_SPREAD = np.uint32(0x9E3779B1)
#: Digits, marks and white space say nothing of a language: one symbol, as the edge of words. Case is dropped.
FOLD = np.zeros(256, np.uint32)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)


def subwords(data: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the subword of `size` bytes that ends at each position; before a text's first byte stand edges.

    `begins` has, for each position, the place within its text, as far as it is less than the longest size.
    """
    folded = np.concatenate([np.zeros(size - 1, np.uint32), FOLD[data]])
    n = len(data)
    code = np.zeros(n, np.uint32)
    for k in range(size):
        own = folded[k : k + n]
        code = code * np.uint32(0x01000193) + np.where(begins >= size - 1 - k, own, np.uint32(0)) + np.uint32(1)
    return ((code * _SPREAD + np.uint32(size)) * _SPREAD >> np.uint32(19)).astype(np.int32)


def places(n: int, offsets: np.ndarray) -> np.ndarray:
    """The place of each of n positions within its text, 8 at most."""
    place = np.full(n, 8, np.int8)
    for k in range(7, -1, -1):
        at = offsets[:-1] + k
        place[at[at < offsets[1:]]] = k
    return place


def buckets(samples: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares) of the subwords of each text; for the bounded training sample only."""
    data, offsets = _joined(samples)
    place, out = places(len(data), offsets), []
    ids = np.column_stack([subwords(data, place, size) for size in SIZES])
    for a, b in zip(offsets[:-1], offsets[1:]):
        found, times = np.unique(ids[a:b], return_counts=True)
        out.append((found, (times / max(1, len(SIZES) * (b - a))).astype(np.float32)))
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Class weights of each bucket (embeddings times softmax layer), bias, temperature, least confidence."""

    names: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """A text's logits depend on that text alone; texts of over `block` bytes are summed up block by block."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        size = np.diff(offsets)
        cuts = -(-size // block)
        owner = np.repeat(np.arange(len(size)), cuts)
        first = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * block
        ends = np.minimum(first + block, offsets[owner + 1])
        place, at = places(len(data), offsets), 0
        while at < len(owner):
            end = max(at + 1, int(np.searchsorted(ends, first[at] + 2 * block, "right")))
            a, b = first[at], ends[end - 1]
            lead = min(a, max(SIZES) - 1)
            sums = np.zeros((b - a, len(self.names)), np.float32)
            for k in SIZES:
                sums += self.weights[subwords(data[a - lead : b], place[a - lead : b], k)[lead:]]
            np.add.at(out, owner[at:end], np.add.reduceat(sums, first[at:end] - a, axis=0, dtype=np.float64))
            at = end
        return out / np.maximum(1, len(SIZES) * size)[:, None] + self.bias

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(data, offsets) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _joined(samples: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in samples]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def fit(samples: list[tuple[str, str]], held: list[tuple[str, str]], width: int = 16, passes: int = 40, rate: float = 2.0, wrong: float = 0.005, seed: int = 3) -> LanguageModel:
    """Train on (text, language) samples; temperature and rejection are set on the held ones."""
    names = tuple(sorted({lang for _, lang in samples}))
    x = buckets([t for t, _ in samples])
    y = np.array([names.index(lang) for _, lang in samples])
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (BUCKETS, width)).astype(np.float32)
    layer, bias = np.zeros((width, len(names)), np.float32), np.zeros(len(names), np.float32)
    scale = np.float32(np.sqrt(BUCKETS) / 8)
    batches = max(1, -(-len(y) // 64))
    for turn in range(passes):
        step = np.float32(rate * (1 - turn / passes))
        for at in np.array_split(rng.permutation(len(y)), batches):
            own = np.zeros((len(at), BUCKETS), np.float32)
            for row, k in zip(own, at):
                row[x[k][0]] = x[k][1]
            hidden = own @ embed * scale
            error = _softmax(hidden @ layer + bias).astype(np.float32)
            error[np.arange(len(at)), y[at]] -= 1
            error /= len(at)
            back = error @ layer.T
            layer -= step * (hidden.T @ error)
            bias -= step * error.sum(0)
            embed -= step * scale * (own.T @ back)
    model = LanguageModel(names, (embed @ layer * scale).astype(np.float32), bias.astype(float))
    held = [(t, lang) for t, lang in held if lang in names]
    if not held:
        return model
    logits, truth = model.logits(*_joined([t for t, _ in held])), np.array([names.index(lang) for _, lang in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    best = float(grid[int(np.argmin(loss))])
    shares = _softmax(logits / best)
    sure, right = shares.max(1), shares.argmax(1) == truth
    order = np.argsort(-sure, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= wrong)
    return LanguageModel(names, model.weights, model.bias, best, float(sure[order[fine[-1]]]) if len(fine) else 1.0)


def training_samples(docs: DataFrame, per_language: int, held_per_language: int, most_documents: int, most_bytes: int) -> tuple[list, list]:
    """Whole texts of every language outside the held-out fold, those of lowest hashed id: per_language and
    held_per_language of each, fewer where that is over most_documents in all. Texts of over most_bytes aren't drawn, so the
    sample takes most_documents * most_bytes at most, whatever the size of the table."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.octet_length(F.col("text").cast("string")).alias("bytes"))
    known = known.where((fold != 0) & F.col("lang").isNotNull() & (F.col("bytes") <= most_bytes)).select("doc_id", "lang")
    number = known.agg(F.approx_count_distinct("lang")).first()[0]
    each = max(2, min(per_language + held_per_language, most_documents // max(1, number)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang").distinct()
    share = held_per_language / (per_language + held_per_language)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(10_000)) < int(10_000 * share)
    rows = texts(docs).join(F.broadcast(ids), "doc_id").where("text is not null").select("lang", "text", draw.alias("held")).orderBy("lang", "text").collect()
    split = [[(r["text"], r["lang"]) for r in rows if r["held"] == held] for held in (False, True)]
    return (split[0], split[1]) if split[0] else (split[1], [])


#: A letter, in any alphabet.
LETTER = re.compile(r"[^\W\d_]")


def languages(docs: DataFrame, per_language: int = 400, held_per_language: int = 150, most_documents: int = 20_000, most_bytes: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every whole text.

    Learns every language outside the held-out fold from at most per_language of its texts (and held_per_language more
    for calibration), most_documents of all languages together, none over most_bytes long; scoring reads all texts
    whole, however long. A text's answer depends on that text alone, and repeated rows get the same one. lang_pred is `und` with score 0 where the text is null or has no letter, or
    nothing could be learnt. `rejected` marks answers less sure than the calibrated least confidence. Other columns are ignored; an empty table gives no rows.
    """
    train, held = training_samples(docs, per_language, held_per_language, most_documents, most_bytes)
    model = fit(train, held) if train else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores, doubts = [], [], []
            for first, end, data, offsets in text_pieces(batch.column(1)):
                column = batch.column(1).slice(first, end - first)
                spoken = np.array([t is not None and LETTER.search(t) is not None for t in column.to_pylist()], bool)
                if model is None:
                    names += ["und"] * (end - first)
                    scores.append(np.zeros(end - first))
                    doubts.append(np.ones(end - first, bool))
                    continue
                shares = model.shares(data, offsets)
                best = shares.max(1)
                names += [model.names[i] if ok else "und" for i, ok in zip(shares.argmax(1), spoken)]
                scores.append(np.where(spoken, best, 0.0))
                doubts.append(~spoken | (best < model.least))
            joined = [np.concatenate(v) if v else np.zeros(0) for v in (scores, doubts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(joined[0], pa.float64()), pa.array(joined[1].astype(bool))], ["doc_id", "lang_pred", "score", "rejected"])

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    scored = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
