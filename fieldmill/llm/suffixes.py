"""Removal of byte strings that an earlier document holds, by merging sparse Burrows-Wheeler transforms.

A string of `length` bytes repeats across documents exactly if two suffixes of different documents share that
long a prefix. Suffixes are sampled: in every `length` bytes the `anchor`-byte string of least hash is an anchor, so
equal strings have equal anchors at equal places, and only anchors that two documents hold can
belong to a repeat. Around these, shards (batches of documents) sort the suffixes that start at their anchors
and keep, as a transform does, the bytes before each.

The shards' transforms of one bucket of anchors are merged by interleave refinement: the order starts as
shard after shard and is refined symbol by symbol within its blocks, by stable steps that keep each shard's
own order; blocks of one suffix drop out. Where neighbours part gives their common prefixes. From there the
last-to-first step follows the bytes before the anchors: one stable step by a byte moves every suffix one place
to the left, until all `length - anchor` places before the anchor are reached. After each step, the intervals of
suffixes with a common prefix of `length` bytes are the repeats, and their least document keeps them.
No step sorts all suffixes, and none shuffles a row per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import mixed, text_pieces
from .common import staged

LENGTH, ANCHOR = 50, 24
BEFORE = LENGTH - ANCHOR
#: A record: the suffix, how much of it and of what precedes it is text, the bytes before it, nearest first.
WIDTH = 80
_CODES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.int64(2**63 - 1)
#: Bytes of a whole copy's note: its id and the beginning of its text's hash.
NOTE = 24
#: Bits of an anchor's hash that are compared; others only send a few strings to be compared in vain.
_KEPT = np.uint64(2**48 - 1)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of `width` values."""
    step, out = 1, x
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of texts: each string of LENGTH bytes inside a text holds one."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x, power, doubled = _CODES[data], _BASE, {}
    for size in (1, 2, 4, 8):
        doubled[size] = x
        x = x[:-size] * power + x[size:]
        power = np.uint64(pow(int(_BASE), 2 * size, 2**64))
    # sixteen bytes and the eight after them
    h = mixed(x[:-8] * np.uint64(pow(int(_BASE), 8, 2**64)) + doubled[8][16:]) | np.uint64(1)
    least = _sliding(h, BEFORE + 1, np.minimum)
    whole = np.ones(len(least), bool)
    for end in offsets[1:-1]:
        whole[max(0, end - LENGTH + 1) : end] = False
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(BEFORE, np.uint64)])
    at = np.flatnonzero(_sliding(padded, BEFORE + 1, np.maximum) == h)
    return at, h[at] & _KEPT


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Whole numbers as byte planes apart, compressed."""
    raw = values.astype(kind)
    return zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T).tobytes(), 1)


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, byte planes apart, compressed."""
    return _planes(np.diff(values, prepend=np.uint64(0)), "<u8")


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, "<u8"), dtype=np.uint64)


def _anchor_rows(buckets: int):
    """Per bucket and piece of the input: the anchors' hashes, ascending, with their batches; a hash that two documents of a batch hold comes twice.

    A row is a bucket's, not a (bucket, batch)'s: both numbers grow with the input, and rows of one hash each would follow.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            home, hashes, docs = rows.column(0).to_numpy(), [], []
            for first, _, data, offsets in text_pieces(rows.column(1)):
                at, h = anchors(data, offsets)
                hashes.append(h)
                docs.append(first + np.searchsorted(offsets, at, "right") - 1)
            if not hashes:
                continue
            h, doc = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((doc, home[doc], h, h % np.uint64(buckets)))
            h, doc = h[order], doc[order]
            batch = home[doc]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (batch[1:] != batch[:-1])]) if len(h) else np.zeros(0, bool)
            other = np.concatenate([[False], ~new[1:] & (doc[1:] != doc[:-1])]) if len(h) else new
            times = np.ones(int(new.sum()), np.int64)
            times[np.cumsum(new)[other] - 1] = 2
            h, batch = np.repeat(h[new], times), np.repeat(batch[new], times)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else []
            out = [(int(bucket[a]), _packed(h[a:b]), _planes(batch[a:b], "<u4")) for a, b in zip(cuts, [*cuts[1:], len(h)])]
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "hashes", "batches"])

    return run


def _shared_anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """Per batch: those of its anchors that two documents of the whole input hold."""
    h = np.concatenate([_unpacked(b) for b in frame["hashes"]])
    batch = np.concatenate([_from_planes(b, "<u4") for b in frame["batches"]])
    values, times = np.unique(h, return_counts=True)
    held = np.isin(h, values[times > 1])
    h, batch = h[held], batch[held]
    order = np.lexsort((h, batch))
    h, batch = h[order], batch[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (batch[1:] != batch[:-1])]) if len(h) else np.zeros(0, bool)
    h, batch = h[new], batch[new]
    cuts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])) if len(h) else []
    bucket = int(frame["bucket"].iloc[0])
    out = [(int(batch[a]), "anchors", bucket, _packed(h[a:b])) for a, b in zip(cuts, [*cuts[1:], len(h)])]
    return pd.DataFrame(out, columns=["batch", "kind", "bucket", "data"])


NOTE_TYPE = "batch int, kind string, bucket int, data binary"


def _records(table: pa.Table, notes: dict[str, list], buckets: int) -> tuple[np.ndarray, ...] | None:
    """Of one batch: the distinct records, bucket by bucket in suffix order, with their bucket and least document, and for every
    occurrence its record, document row, position and id. The same rows give the same numbers each time."""
    shared = np.unique(np.concatenate([_unpacked(d) for _, d in notes["anchors"]])) if notes["anchors"] else np.zeros(0, np.uint64)
    ids = table.column("doc_id").to_numpy()
    use = ~_copied(table, notes["copies"])
    found = []
    for first, _, data, offsets in text_pieces(table.column("text")):
        at, h = anchors(data, offsets)
        doc = np.searchsorted(offsets, at, "right") - 1
        slot = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        ok = (shared[slot] == h if len(shared) else np.zeros(len(h), bool)) & use[first + doc]
        at, h, doc = at[ok], h[ok], doc[ok]
        if not len(at):
            continue
        left, right = np.minimum(at - offsets[doc], BEFORE), np.minimum(offsets[doc + 1] - at, LENGTH)
        record = np.zeros((len(at), WIDTH), np.uint8)
        where = at[:, None] + np.arange(LENGTH)
        record[:, :LENGTH] = np.where(np.arange(LENGTH) < right[:, None], data[np.minimum(where, len(data) - 1)], 0)
        record[:, LENGTH], record[:, LENGTH + 1] = right, left
        where = at[:, None] - 1 - np.arange(BEFORE)
        record[:, LENGTH + 2 : LENGTH + 2 + BEFORE] = np.where(np.arange(BEFORE) < left[:, None], data[np.maximum(where, 0)], 0)
        found.append((record, h % np.uint64(buckets), first + doc, at - offsets[doc]))
    if not found:
        return None
    record, bucket, doc, at = (np.concatenate(x) for x in zip(*found))
    words = record.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], bucket))
    words, bucket, doc, at, record = words[order], bucket[order], doc[order], at[order], record[order]
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (words[1:] != words[:-1]).any(1)])
    starts, which = np.flatnonzero(new), np.cumsum(new) - 1
    return record[starts], bucket[starts].astype(np.int64), np.minimum.reduceat(ids[doc], starts), which, doc, at, ids[doc]


def _by_kind(notes: pa.Table) -> dict[str, list]:
    out: dict[str, list] = {"copies": [], "anchors": [], "masks": []}
    for kind, bucket, data in zip(notes.column("kind").to_pylist(), notes.column("bucket").to_pylist(), notes.column("data").to_pylist()):
        out[kind].append((bucket, data))
    return out


def _copied(table: pa.Table, notes: list) -> np.ndarray:
    """Which rows are noted as whole copies. A note is an id and a hash of the text, as rows of unlike texts may share an id."""
    raw = b"".join(d for _, d in notes)
    known = {raw[i : i + NOTE] for i in range(0, len(raw), NOTE)}
    ids = table.column("doc_id").to_numpy()
    out = np.isin(ids, np.frombuffer(raw, [("id", ">i8"), ("hash", "V16")])["id"].astype(np.int64))
    for i in np.flatnonzero(out):
        out[i] = int(ids[i]).to_bytes(8, "big", signed=True) + hashlib.sha256(table.column("text")[int(i)].as_buffer()).digest()[: NOTE - 8] in known
    return out


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _shard(buckets: int):
    """One batch's part of the transforms: per bucket its sorted records and their least documents."""
    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            batch = table.column("batch")[0].as_py()
            if found := _records(_in_order(table), _by_kind(notes), buckets):
                record, bucket, least, *_ = found
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
                    rows.append((int(bucket[a]), batch, zstandard.compress(record[a:b].tobytes(), 3), least[a:b].astype("<i8").tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "batch", "records", "least"])

    return run


def interleave(words: np.ndarray) -> np.ndarray:
    """The merged order of rows that come as sorted shards, one after another: refined word by word in blocks.

    Each step is stable, so rows of a shard never change places with their like; blocks of one row are done.
    """
    n, count = words.shape
    order, block = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n)
    for k in range(count):
        if not len(active):
            break
        rows = order[active]
        step = np.lexsort((words[rows, k], block[active]))
        order[active] = rows = rows[step]
        part = block[active]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (words[rows[1:], k] != words[rows[:-1], k])])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(active)))
        block[active] = active[starts][np.cumsum(new) - 1]
        active = active[np.repeat(sizes > 1, sizes)]
    return order


def repeats(record: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each record a bit for every place j before its anchor: whether the string that starts there is one
    whole string of text and a record of a smaller document has it too."""
    n = len(record)
    words = record[:, :56].copy()
    words[:, LENGTH:] = 0
    order = interleave(words.view(">u8").astype(np.uint64).reshape(n, -1))
    suffix = record[order, :LENGTH]
    common = np.zeros(n, np.int64)  # of each suffix with the one before it
    differs = suffix[1:] != suffix[:-1]
    common[1:] = np.where(differs.any(1), differs.argmax(1), LENGTH)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    right, left = record[:, LENGTH].astype(int), record[:, LENGTH + 1].astype(int)
    mask = np.zeros(n, np.int32)
    alike = np.zeros(n, np.int64)  # rows whose j bytes before the anchor are the same
    for j in range(BEFORE + 1):
        if j:
            byte = record[order, LENGTH + 1 + j]
            step = np.argsort(byte, kind="stable")  # last-to-first: all suffixes move one place to the left
            order, byte = order[step], byte[step]
            was = alike[order]
            alike[order] = np.cumsum(np.concatenate([[True], (byte[1:] != byte[:-1]) | (was[1:] != was[:-1])]))
        prefix = np.cumsum(common < LENGTH - j)[rank[order]]
        new = np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (alike[order][1:] != alike[order][:-1])])
        whole = (left[order] >= j) & (right[order] >= LENGTH - j)
        own = np.where(whole, least[order], _LAST)
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(own, starts)[np.cumsum(new) - 1]
        mask[order] |= np.where(whole & (first < own), np.int32(1 << j), np.int32(0))
    return mask


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Merge the shards of one bucket and give each shard's records their bits back."""
    frame = frame.sort_values("batch", kind="stable")
    parts = [np.frombuffer(zstandard.decompress(r), np.uint8).reshape(-1, WIDTH) for r in frame["records"]]
    mask = repeats(np.concatenate(parts), np.concatenate([np.frombuffer(x, "<i8") for x in frame["least"]]))
    cuts = np.cumsum([0, *map(len, parts)])
    rows = [(b, "masks", k, zstandard.compress(mask[x:y].astype("<i4").tobytes(), 1)) for b, k, x, y in zip(frame["batch"], frame["bucket"], cuts[:-1], cuts[1:])]
    return pd.DataFrame(rows, columns=["batch", "kind", "bucket", "data"])


CLEAN_TYPE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cleaned(buckets: int, with_bytes: bool):
    def run(table: pa.Table, notes: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if table.num_rows:
            table, by_kind = _in_order(table), _by_kind(notes)
            ids = table.column("doc_id").to_numpy()
            masks = {b: np.frombuffer(zstandard.decompress(d), "<i4") for b, d in by_kind["masks"]}
            doc_of, start_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if found := _records(table, by_kind, buckets):
                # all buckets at once: a step for each of them would take time for buckets times batches
                record, bucket, least, which, doc, at, own_id = found
                mask = np.concatenate([masks[b] for b in np.unique(bucket).tolist()])
                right, left = record[:, LENGTH].astype(int), record[:, LENGTH + 1].astype(int)
                later = own_id > least[which]
                for j in range(BEFORE + 1):
                    whole = (left >= j) & (right >= LENGTH - j)
                    gone = (mask >> j & 1 == 1)[which] | (whole[which] & later)
                    doc_of.append(doc[gone])
                    start_of.append(at[gone] - j)
            doc, start = np.concatenate(doc_of), np.concatenate(start_of)
            order = np.argsort(doc, kind="stable")
            doc, start = doc[order], start[order]
            copied = _copied(table, by_kind["copies"])
            for first, end, data, offsets in text_pieces(table.column("text")):
                for i in range(first, end):
                    text = data[offsets[i - first] : offsets[i - first + 1]]
                    gone = np.zeros(len(text) + 1, np.int32)
                    a, b = np.searchsorted(doc, (i, i + 1))
                    np.add.at(gone, start[a:b], 1)
                    np.add.at(gone, start[a:b] + LENGTH, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    if copied[i]:
                        gone[:] = True
                    kept = text[~gone].tobytes()
                    out[0].append(None if ids[i] == _LAST else int(ids[i]))
                    out[1].append(len(text))
                    out[2].append(int(gone.sum()))
                    out[3].append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(text) else 0)
                    out[4].append(hashlib.sha256(kept).hexdigest())
                    out[5].append(kept if with_bytes else None)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = False, batch_bytes: int = 4 << 20, anchors_per_bucket: int = 600_000) -> DataFrame:
    """Every document without the bytes that a 50-byte string covers which also starts in a document of smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if asked for, the
    kept bytes. Null texts are empty. Strings of one document, or of rows that repeat an id, don't count
    against each other; each row is judged by its own text. A row without an id comes after all others. Texts are taken whole,
    however long. Other columns are ignored; an empty table gives no rows.
    """
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    batches = max(1, -(-int(total) // batch_bytes))
    buckets = max(1, -(-int(total) // 16 // anchors_per_bucket))
    homed = given.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "text")

    # a text that a smaller document has whole is gone as a whole and is looked at no further
    alike = given.where(F.octet_length("text") >= LENGTH).select("doc_id", F.sha2("text", 256).alias("sha"))
    firsts = alike.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    copies = alike.join(firsts, "sha").where("doc_id > first").select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "doc_id", "sha").distinct()
    note = F.unhex(F.concat(F.lpad(F.hex("doc_id"), 16, "0"), F.substring("sha", 1, 2 * (NOTE - 8))))
    copies = staged(copies.select("batch", F.lit("copies").alias("kind"), F.lit(0).alias("bucket"), note.alias("data")), "copies")

    seen = homed.select("batch", "text").mapInArrow(_anchor_rows(buckets), "bucket int, hashes binary, batches binary")
    shared = staged(seen.groupBy("bucket").applyInPandas(_shared_anchors, NOTE_TYPE), "anchors")
    notes = copies.union(shared)

    shards = homed.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(_shard(buckets), "bucket int, batch int, records binary, least binary")
    masks = staged(shards.groupBy("bucket").applyInPandas(_merge, NOTE_TYPE), "masks")
    done = homed.groupBy("batch").cogroup(notes.union(masks).groupBy("batch")).applyInArrow(_cleaned(buckets, with_bytes), CLEAN_TYPE)
    return done if with_bytes else done.drop("kept")
