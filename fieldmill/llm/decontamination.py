"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index holds, per term, the items it occurs in and its BM25 weight there as a share of what the item
scores against itself, so scores run from 0 to 1. Items stand in blocks; with each term goes its highest weight
in each block. As in block-max WAND, a passage looks into a block only if the sum of its terms' highest
weights there can reach the threshold, so all items above it are found and most are never scored. The
commonest terms are not looked up for that: what they can add to an item of a block at most is known beforehand.
Found items are verified by word n-grams: both the question and the answer must recur in the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import _PLACE, SEPARATES_MARKS, mixed, text_pieces, word_hashes
from .common import texts

HIT_TYPE = "doc_id long, item_id long, score double, question_share double, answer_share double"


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: what follows the last 'Answer:' mark or question mark, else its last sentence, is the answer.

    A text that has no such place is all question.
    """
    for cut in (r".*\banswer\s*:", r".*\?(?=\s)", r".*[.!?](?=\s+\S)"):
        if (m := re.match(cut, text, re.S | re.I)) and re.search(r"\w", text[m.end() :]):
            return text[: m.end()], text[m.end() :]
    return text, ""


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), SEPARATES_MARKS)[0]


def ngrams(words: np.ndarray, size: int) -> np.ndarray:
    mix = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        mix += words[k : k + len(mix)] * _PLACE[k]
    return mixed(mix)


@dataclass
class ItemIndex:
    """Inverted index of some test items with block maxima."""

    ids: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    vocabulary: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray
    block: int
    longest: int
    telling: np.ndarray
    rest_max: np.ndarray
    sieve: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, common_share: float = 0.35) -> ItemIndex:
        parts = [tuple(_words(p) for p in question_and_answer(t)) for _, t in rows]
        words = [np.concatenate(p) for p in parts]
        usual = max(1.0, np.mean([len(w) for w in words]))
        vocabulary, held = np.unique(np.concatenate([np.unique(w) for w in words]), return_counts=True)
        idf = np.log(1 + (len(rows) - held + 0.5) / (held + 0.5))
        triples = []
        for i, w in enumerate(words):
            terms, tf = np.unique(w, return_counts=True)
            at = np.searchsorted(vocabulary, terms)
            weight = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(w) / usual))
            triples.append(np.column_stack([at, np.full(len(at), i), weight / max(1e-9, weight.sum())]))
        posts = np.concatenate(triples)
        posts = posts[np.lexsort((posts[:, 1], posts[:, 0]))]
        terms, items, weights = posts[:, 0].astype(int), posts[:, 1].astype(int), posts[:, 2]
        block = max(16, -(-len(rows) // 64))
        block_max = np.zeros((len(vocabulary), -(-len(rows) // block)))
        np.maximum.at(block_max, (terms, items // block), weights)
        starts = np.searchsorted(terms, np.arange(len(vocabulary) + 1))
        # the commonest terms, as many as together never give an item more than common_share
        telling, rest = np.ones(len(vocabulary), bool), np.zeros(len(rows))
        for t in np.argsort(-held, kind="stable"):
            own = slice(starts[t], starts[t + 1])
            if (rest[items[own]] + weights[own]).max() > common_share:
                break
            rest[items[own]] += weights[own]
            telling[t] = False
        rest_max = np.zeros(block_max.shape[1])
        np.maximum.at(rest_max, np.arange(len(rows)) // block, rest)
        sieve = np.zeros(1 << 20, bool)
        sieve[(vocabulary[telling] >> np.uint64(44)).astype(int)] = True
        return cls(np.array([i for i, _ in rows]), parts, vocabulary, starts, items, weights, block_max, block, max(8, max(map(len, words))), telling, rest_max, sieve)

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        """The distinct terms among some words."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.unique(at[self.vocabulary[at] == words])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Exact scores of all items that hold one of the distinct terms."""
        spans = [np.arange(self.starts[t], self.starts[t + 1]) for t in terms]
        at = np.concatenate(spans) if spans else np.zeros(0, int)
        return np.bincount(self.items[at], self.weights[at], len(self.ids))

    def retrieve(self, words: np.ndarray, first: np.ndarray, least: float) -> Iterator[tuple[int, int, float, np.ndarray]]:
        """(text, item, score, passage words) of every passage and item that score `least` or more.

        Passages are runs of two spans of `longest` words, one span apart: any run as long as the
        longest item lies in one of them whole.
        """
        sizes = np.diff(first)
        spans = -(-sizes // self.longest)
        base = np.concatenate([[0], np.cumsum(spans)])
        if not base[-1]:
            return
        some = np.flatnonzero(self.sieve[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
        known = (self.vocabulary[at] == words[some]) & self.telling[at]
        some, at = some[known], at[known]
        doc = np.searchsorted(first, some, "right") - 1
        span = base[doc] + (some - first[doc]) // self.longest
        of_span, term = np.divmod(np.unique(span * len(self.vocabulary) + at), len(self.vocabulary))
        owner = np.repeat(np.arange(len(sizes)), spans)
        two = np.append(owner[1:] == owner[:-1], False)
        reach = np.zeros(base[-1], bool)
        for b in range(self.block_max.shape[1]):
            bound = np.bincount(of_span, self.block_max[term, b], base[-1]) + self.rest_max[b] / 2
            reach |= bound + np.where(two, np.append(bound[1:], 0), self.rest_max[b] / 2) >= least - 1e-9
        for s in np.flatnonzero(reach):
            i = owner[s]
            start = first[i] + (s - base[i]) * self.longest
            passage = words[start : min(first[i + 1], start + 2 * self.longest)]
            own = self.terms_of(passage)
            blocks = self.block_max[own].sum(0) >= least - 1e-9
            if blocks.any():
                score = self.scores(own)
                for item in np.flatnonzero((score >= least - 1e-9) & blocks[np.arange(len(score)) // self.block]):
                    yield i, item, score[item], passage

    def shares(self, item: int, passage: np.ndarray, size: int = 5) -> tuple[float, float]:
        """Shares of the question's and the answer's word n-grams that the passage holds; 1 for an empty part.

        A part of less than four times `size` words has shorter n-grams, down to single words, so that one changed word of a short
        answer leaves most of them.
        """
        out = []
        for part in self.parts[item]:
            n = max(1, min(size, len(part) // 4)) if len(part) else 0
            out.append(float(np.isin(ngrams(part, n), ngrams(passage, n)).mean()) if n else 1.0)
        return out[0], out[1]


def item_indexes(items: DataFrame, items_per_index: int) -> Iterator[ItemIndex]:
    """Indexes of slices of the items, each of a bounded number, whatever the number of items."""
    item_rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    slices = -(-item_rows.count() // items_per_index)
    for part in range(slices):
        own = item_rows.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect() if len(_words(r["text"]))]
        if rows:
            yield ItemIndex.build(rows)


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.6, question: float = 0.6, answer: float = 0.5, items_per_index: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share) of every test item that a document holds.

    One row per document and item, with the best passage's figures. Items are indexed in slices of about
    items_per_index, so what is sent to executors stays bounded; each slice is one pass over the documents.
    Items without a word and null texts match nothing. Items that repeat a text are each reported, rows that repeat an id together. Texts are
    searched whole, passage by passage, however long. Empty tables give no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    hits = spark.createDataFrame([], HIT_TYPE)
    for index in item_indexes(items, items_per_index):
        hits = hits.union(texts(docs).mapInArrow(_finder(spark.sparkContext.broadcast(index), least, question, answer), HIT_TYPE))
    best = F.max(F.struct("score", "question_share", "answer_share")).alias("x")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def _finder(shared, least: float, question: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for row, _, data, offsets in text_pieces(batch.column(1)):
                words, first = word_hashes(data, offsets, SEPARATES_MARKS)
                for i, item, score, passage in index.retrieve(words, first, least):
                    q, a = index.shares(item, passage)
                    if q >= question and a >= answer:
                        found.append((ids[row + i], int(index.ids[item]), float(score), q, a))
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "score", "question_share", "answer_share"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, least: float = 0.6, question: float = 0.6, answer: float = 0.5, items_per_index: int = 20_000) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, _, data, offsets in text_pieces(batch.column("text")):
                    words, first = word_hashes(data, offsets, SEPARATES_MARKS)
                    for i, item, _, passage in shared.value.retrieve(words, first, least):
                        q, a = shared.value.shares(item, passage)
                        keep[row + i] &= q < question or a < answer
                yield batch.filter(pa.array(keep))

        return run

    for index in item_indexes(items, items_per_index):
        docs = docs.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
