"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

What is planned is not documents but lengths: there are at most `capacity` of them, so the plan
(how many sequences hold which lengths) is as large for a hundred terabytes as for a megabyte. The plan
begins as best fit with lengths falling, then local search moves one piece, exchanges one for one or
two for one between underfull sequences as long as that increases the sum of squared fills, which empties
the emptier ones. Pieces then take their places from their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged, texts

PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of byte-level BPE; the same ids as the vocabulary's own library gives.

    The vocabulary file is read as ranks for a faster encoder; texts that spell one of the vocabulary's
    special tokens go through the vocabulary's own library.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(vocabulary)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _cutter(vocabulary: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encoder.ids(text.as_py() or ""), end_id], "<u4")
                start, length = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, length = start + length, capacity
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Token pieces of every document: its ids and the end id, cut so that only the first piece is short."""
    return texts(docs).mapInArrow(_cutter(vocabulary, end_id, capacity), PIECE_TYPE)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit by falling length, many equal pieces at a time: {lengths in a sequence: how many such}."""
    open_by: dict[int, Counter] = {}
    done: Counter = Counter()

    def put(pattern: tuple[int, ...], left: int, many: int) -> None:
        if many:
            (done if left == 0 else open_by.setdefault(left, Counter()))[pattern] += many

    for size in sorted(counts, reverse=True):
        to_place = counts[size]
        for left in sorted(x for x in open_by if x >= size):
            fit = left // size
            for pattern, many in list(open_by[left].items()):
                if not to_place:
                    break
                whole = min(many, to_place // fit)
                rest = to_place - whole * fit if whole < many and to_place - whole * fit < fit else 0
                open_by[left][pattern] -= whole + (rest > 0)
                if not open_by[left][pattern]:
                    del open_by[left][pattern]
                put(pattern + (size,) * fit, left - fit * size, whole)
                if rest:
                    put(pattern + (size,) * rest, left - rest * size, 1)
                to_place -= whole * fit + rest
            if not open_by[left]:
                del open_by[left]
        fit = capacity // size
        put((size,) * fit, capacity - fit * size, to_place // fit)
        if to_place % fit:
            put((size,) * (to_place % fit), capacity - to_place % fit * size, 1)
    for left, patterns in open_by.items():
        done.update(patterns)
    return done


def _exchange(donor: tuple[int, ...], taker: tuple[int, ...], capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The move, one-for-one or two-for-one exchange that fills the taker most, if it raises the squared fill."""
    room, gap = capacity - sum(taker), sum(donor) - sum(taker)
    gives = [(x,) for x in sorted(set(donor))]
    gives += [tuple(p) for p in {tuple(sorted((a, b))) for i, a in enumerate(donor) for b in donor[i + 1 :]}]
    takes = [(), *((x,) for x in sorted(set(taker)))]
    takes += [tuple(p) for p in {tuple(sorted((a, b))) for i, a in enumerate(taker) for b in taker[i + 1 :]}]
    best, most = None, max(0, gap)
    for give in gives:
        for take in takes:
            if len(give) + len(take) <= 3 and (len(give) == 1 or take) and most < (gain := sum(give) - sum(take)) <= room:
                best, most = (give, take), gain
    return best


def local_search(plan: Counter, capacity: int) -> Counter:
    """Raise the sum of squared fills by exchanges from the emptiest sequences; emptied ones go.

    Ends when no exchange between any two underfull kinds of sequence helps, or when sequences are as few as the total
    length allows. Two kinds that had no exchange have none later, so no two are tried twice; every exchange raises
    the squared fill, so the search ends.
    """
    plan = Counter(plan)
    total = sum(sum(p) * m for p, m in plan.items())
    fewest, barren = -(-total // capacity), set()
    while sum(plan.values()) > fewest:
        under = sorted((p for p in plan if sum(p) < capacity), key=lambda p: (sum(p), p))
        pairs = ((d, t) for i, d in enumerate(under) for t in reversed(under[i:]) if (d, t) not in barren and (d != t or plan[d] > 1))
        for donor, taker in pairs:
            if found := _exchange(donor, taker, capacity):
                break
            barren.add((donor, taker))
        else:
            break
        give, take = (Counter(x) for x in found)
        times = min(plan[donor], plan[taker]) if donor != taker else plan[donor] // 2
        after = [tuple(sorted((Counter(x) - out + back).elements(), reverse=True)) for x, out, back in ((donor, give, take), (taker, take, give))]
        plan.subtract({donor: times})
        plan.subtract({taker: times})
        plan.update({p: times for p in after[:1] if p})
        plan.update({after[1]: times})
        plan += Counter()
    return plan


def plan_rows(plan: Counter) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many in a sequence, first sequence, offset): which ranks of a length go where."""
    rows, used, base = [], Counter(), 0
    for pattern in sorted(plan, reverse=True):
        offset = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, used[size], each, base, offset))
            used[size] += each * plan[pattern]
            offset += each * size
        base += plan[pattern]
    return sorted(rows)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and its place there.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. An empty
    table gives no rows. Extra columns are ignored, whatever their names. Texts are encoded whole, however long.
    """
    pieces = staged(cut_pieces(docs, vocabulary, end_id, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_rows(local_search(best_fit(counts, capacity), capacity)) if counts else [(1, 0, 1, 0, 0)]
    table = np.array(plan, np.int64)
    key = table[:, 0] << 44 | table[:, 1]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            _, low, each, base, offset = table[np.searchsorted(key, f["length"].to_numpy() << 44 | f["rank"].to_numpy(), "right") - 1].T
            at = f["rank"].to_numpy() - low
            yield f.drop(columns="rank").assign(sequence_id=base + at // each, offset=offset + at % each * f["length"].to_numpy())

    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", sum(counts.values()))
    return ranked.mapInPandas(place, f"{PIECE_TYPE}, sequence_id long, offset long")
