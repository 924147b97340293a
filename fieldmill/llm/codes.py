"""Vector codes: each vector as four table indexes, the tables trained by Elkan's form of Lloyd's rounds, in integers.

What a vector keeps from round to round, for each of its parts: its entry, an upper bound of the distance to it, and a
lower bound of the distance to every entry. When entries move, bounds shift by the length of the move. An entry is left out only if
its lower bound, or half its distance from the part's own entry, is strictly beyond the upper bound; the others are
compared exactly, the smaller index winning ties. Upper bounds are rounded up and lower bounds down to integers, so that no rounding can leave out an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import drop_staged, staged
from .vectors import all_apart, apart, root_down, root_up, whole_rows

#: Rows that are held against all entries at once.
BLOCK = 2048


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(rows.itemsize * rows.shape[1]), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _unpacked(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def first_bounds(x: np.ndarray, entries: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of parts that have no bounds yet: held against every entry. Lower bounds count in units."""
    d = all_apart(x, entries)
    own = d.argmin(axis=1)  # the first of the least
    return own, root_up(d[np.arange(len(x)), own]), root_down(d) // unit


def tightened(x: np.ndarray, entries: np.ndarray, between: np.ndarray, moves: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, upper, lower, exact distances taken) after the entries have moved by `moves`; `between`: distances between entries, rounded down.

    Lower bounds and moves count in units, so that a bound shifts by a subtraction.
    """
    rows = np.arange(len(x))
    lower = np.maximum(lower - (-(-moves // unit)).astype(lower.dtype)[None, :], 0)
    upper = upper + moves[own]

    def open_pairs(r: np.ndarray) -> np.ndarray:
        out = lower[r] <= (upper[r] // unit).astype(lower.dtype)[:, None]
        out &= between[own[r]] <= np.minimum(2 * upper[r], 2**31 - 1).astype(between.dtype)[:, None]
        out[np.arange(len(r)), own[r]] = False
        return out

    stale = rows[open_pairs(rows).any(axis=1)]
    exact = apart(x[stale], entries[own[stale]])
    upper[stale], lower[stale, own[stale]] = root_up(exact), root_down(exact) // unit
    at, entry = np.nonzero(open_pairs(stale))
    d = np.concatenate([apart(x[stale[at[i : i + BLOCK * 16]]], entries[entry[i : i + BLOCK * 16]]) for i in range(0, len(at), BLOCK * 16)] or [np.zeros(0, np.int64)])
    lower[stale[at], entry] = root_down(d) // unit
    # of each part's own and compared entries the nearest, of those the first
    part, d, entry = np.concatenate([np.arange(len(stale)), at]), np.concatenate([exact, d]), np.concatenate([own[stale], entry])
    order = np.lexsort((entry, d, part))
    best = order[np.searchsorted(part[order], np.arange(len(stale)))]
    own = own.copy()
    own[stale], upper[stale] = entry[best], root_up(d[best])
    return own, upper, lower, len(d)


def _round(books: np.ndarray, moves: np.ndarray | None, unit: int):
    """One assignment of all parts; `moves` is None where there are no bounds yet."""
    parts, count, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = [root_down(all_apart(b, b)).astype(np.int32) for b in books]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n = batch.num_rows
                x = _unpacked(batch.column("v"), "<i4", parts, width).astype(np.int64)
                own, upper, lower = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64), np.empty((n, parts, count), np.int32)
                if moves is not None:
                    own[:] = _unpacked(batch.column("own"), "<u2", parts)
                    upper[:] = _unpacked(batch.column("upper"), "<i8", parts)
                    lower[:] = _unpacked(batch.column("lower"), "<u2", parts, count)
                for p in range(parts):
                    if moves is None:
                        own[:, p], upper[:, p], lower[:, p] = first_bounds(x[:, p], books[p], unit)
                    else:
                        own[:, p], upper[:, p], lower[:, p], _ = tightened(x[:, p], books[p], between[p], moves[p], own[:, p], upper[:, p], lower[:, p], unit)
                state = [_packed(own.astype("<u2")), _packed(upper), _packed(lower.reshape(n, -1).astype("<u2"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), *state], ["vec_id", "label", "v", "own", "upper", "lower"])

    return run


def _sums(parts: int, count: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, total = np.zeros(parts * count, np.int64), np.zeros((parts * count, width), np.int64)
        for batch in batches:
            x = _unpacked(batch.column("v"), "<i4", parts, width).astype(np.int64)
            own = _unpacked(batch.column("own"), "<u2", parts).astype(np.int64)
            for p in range(parts):
                order = np.argsort(own[:, p], kind="stable")
                used, starts = np.unique(own[order, p], return_index=True)
                if len(used):
                    total[p * count + used] += np.add.reduceat(x[order, p], starts, axis=0)
                many += np.bincount(p * count + own[:, p], minlength=parts * count)
        used = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(many[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["k", "n", "total"])

    return run


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the exact floor of its parts' mean; an unused one stays."""
    parts, count, width = books.shape
    each = state.select("v", "own").mapInArrow(_sums(parts, count, width), "k long, n long, total array<long>")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = each.select("k", "n", F.posexplode("total").alias("i", "x")).groupBy("k", "i").agg(wide("n").alias("n"), wide("x").alias("x"))
    out = books.reshape(parts * count, width).copy()
    for r in sums.collect():  # as many rows as the tables have components
        out[r["k"], r["i"]] = int(r["x"]) // int(r["n"])
    return out.reshape(books.shape)


def _coded(books: np.ndarray):
    parts, count, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column("v"), "<i4", parts, width).astype(np.int64)
            own = _unpacked(batch.column("own"), "<u2", parts)
            error = sum((apart(x[:, p], books[p][own[:, p]]) for p in range(parts)), np.zeros(len(x), np.int64))
            codes = own.astype("u1").tobytes().hex()
            listed = [codes[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(listed, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _whole(parts: int, dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = whole_rows(batch.column("embedding"), dims, scale)
            top = (x.reshape(len(x), parts, dims // parts) ** 2).sum(axis=2).max(axis=1, initial=0)
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), _packed(x.astype("<i4")), pa.array(top)], ["vec_id", "label", "v", "top"])

    return run


def encode(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) of every vector of `dims` finite components.

    Components become floor(scale * x); a vector is cut into `parts` equal parts. Each part's table begins as that part of the `entries` (at most 256) vectors of smallest
    vec_id, is trained for `rounds` rounds, and codes come from a last assignment. An entry is the floor of its parts' mean.

    Vectors that are null, of another length or hold null or non-finite components are left out. Repeated ids count as rows of their
    own, in order of their vector's bytes where the tables begin; null ids come after all others there. With fewer vectors than entries the tables are
    shorter; an empty table gives no rows. Null labels count as one label. Other columns are ignored, whatever their names. Components
    of 2**26 / scale or more raise an error. Each round writes one table of bounds and deletes the one before; the
    driver holds the tables' entries and their sums, never vectors.
    """
    if not 0 < entries <= 256 or dims % parts:
        raise ValueError("a part has at most 256 entries, and parts are equal")
    label = StructField("label", embeddings.schema["label"].dataType)
    base = [StructField("vec_id", LongType()), label]
    held = [*base, StructField("v", BinaryType())]
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = staged(source.mapInArrow(_whole(parts, dims, scale), StructType([*held, StructField("top", LongType())])), "vectors")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    result = StructType([*base, StructField("code", StringType()), StructField("error", LongType())])
    if not first:
        none = StructType([base[0], *result.fields[2:], StructField("label_error", LongType()), StructField("codebooks_sha256", StringType()), label])
        return embeddings.sparkSession.createDataFrame([], none)
    seeds = np.array([np.frombuffer(r["v"], "<i4") for r in first]).astype(np.int64)
    books = seeds.reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2).copy()
    longest, unit = 2 * int(vectors.agg(F.max("top")).first()[0] ** 0.5 + 1) + 2 * dims, 1
    while longest // unit >= 1 << 16:  # lower bounds are kept in 16 bits
        unit *= 2
    bounds = StructType([*held, *(StructField(c, BinaryType()) for c in ("own", "upper", "lower"))])
    state, moves = vectors, None
    for _ in range(rounds):
        later = staged(state.mapInArrow(_round(books, moves, unit), bounds), "bounds")
        drop_staged(state)
        state, now = later, _moved(later, books)
        moves = np.stack([root_up(apart(a, b)) for a, b in zip(now, books)])
        books = now
    final = state.mapInArrow(_round(books, moves, unit), bounds).mapInArrow(_coded(books), result)
    done = staged(final, "codes")
    drop_staged(state)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # written, so that Spark knows its size: sent to all tasks while small, else joined with large labels split
    per = staged(done.groupBy(F.col("label").alias("_of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    met = done.join(per, F.col("label").eqNullSafe(F.col("_of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
