"""Exact Jaccard self-join of word n-gram sets, by set-relation skipping, up to connected groups.

Sets alike are joined once, through the smallest id of their class. Each set is ordered by one global
order of shingles, rare first as a fixed-size sketch of counts says, and its first tokens go to inverted
lists: two sets that link share a known least number among so many of those (prefix filter with counts).

Each list has a leader, the set of which the largest part is found in lists: where sets derive from one, it is
that one. A set is first compared with the leader it meets in most lists; groups found so are settled. What is left are pairs of unlike groups within one list.
They are found list by list, in blocks by size that skip where size or position rules a link out. Where both were compared with
one leader, their answer is derived from its answers: they share at most what either shares with the leader, and
beyond it at most what either has in common with any other set of that leader. Only pairs that this leaves open are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import mixed, shingle_sets, text_pieces
from .common import connected, drop_staged, staged, texts

CELLS = 1 << 20
SLICES = 16


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with which sets of n and m elements link: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens a set of n elements shows: any set linked with it shares one of them."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _fingerprints(size: int):
    """Per text: id, set size, two 64-bit sums of its set; per task: counts of hashed shingles in slices of a sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        fields = ["doc_id", "n", "fp1", "fp2", "slice", "counts"]
        for batch in batches:
            rows = [[], [], []]
            for _, _, data, offsets in text_pieces(batch.column(1)):
                own = list(shingle_sets(data, offsets, size))
                cells += np.bincount((np.concatenate(own) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
                for s in own:
                    rows[0].append(len(s))
                    rows[1].append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    rows[2].append(int((s * (s | np.uint64(1))).sum()) if len(s) else 0)
            n = len(rows[0])
            sums = [pa.array(np.array(r, np.uint64).view(np.int64)) for r in rows[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), *sums, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], fields)
        blocks = [zstandard.compress(x.astype("<i8").tobytes(), 1) for x in np.split(cells, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64())] * 4 + [pa.array(range(SLICES), pa.int32()), pa.array(blocks, pa.binary())], fields)

    return run


def _rarity(staged_rows: DataFrame) -> np.ndarray:
    """The sketch of all shingle counts, as logarithms: a byte per cell, whatever the size of the input."""
    def add(frames: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(b), "<i8") for b in frames["counts"])
        return pd.DataFrame({"slice": [frames["slice"].iloc[0]], "salt": [0], "counts": [zstandard.compress(total.astype("<i8").tobytes(), 1)]})

    parts = staged_rows.where("slice is not null").select("slice", F.pmod(F.xxhash64("counts"), F.lit(64)).cast("int").alias("salt"), "counts")
    for keys in (["slice", "salt"], ["slice"]):  # no task gathers all tasks' counts
        parts = parts.groupBy(*keys).applyInPandas(add, "slice int, salt int, counts binary")
    blocks = {r["slice"]: np.frombuffer(zstandard.decompress(r["counts"]), "<i8") for r in parts.collect()}
    counts = np.concatenate([blocks[i] for i in range(SLICES)]) if blocks else np.zeros(CELLS)
    usual = max(1.0, float(counts.mean()))
    return np.clip(np.log2(np.maximum(counts / usual, 1.0)) * 2, 0, 63).astype(np.uint8)


def _ordered(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    key = rarity[(s >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
    return s[np.argsort(key, kind="stable")]


def _prefixes(shared, size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[], [], []]
            for row, _, data, offsets in text_pieces(batch.column(1)):
                for i, s in enumerate(shingle_sets(data, offsets, size)):
                    if len(s):
                        out[0].append(ids[row + i])
                        out[1].append(len(s))
                        out[2].append(_ordered(s, rarity)[: int(prefix_size(np.array(len(s)), percent))].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["doc_id", "n", "prefix"])

    return run


_ENTRY = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _to_lists(buckets: int):
    """Prefix rows to packed (bucket, entries) rows: one for each bucket and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, "<u8") for p in batch.column(2).to_pylist()]
            if not prefixes:
                continue
            sizes = np.array([len(p) for p in prefixes])
            e = np.zeros(sizes.sum(), _ENTRY)
            e["token"] = np.concatenate(prefixes)
            e["doc"] = np.repeat(batch.column(0).to_numpy(), sizes)
            e["n"] = np.repeat(batch.column(1).to_numpy(), sizes)
            e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            bucket = (mixed(e["token"]) >> np.uint64(32)).astype(np.int64) % buckets
            order = np.lexsort((e["token"], bucket))
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = [(int(bucket[order[a]]), _packed(e[order[a:b]])) for a, b in zip(cuts, [*cuts[1:], len(e)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "entries"])

    return run


def _packed(e: np.ndarray) -> bytes:
    """Columns apart, tokens as differences, byte planes apart, compressed."""
    columns = (np.diff(e["token"], prepend=np.uint64(0)), e["doc"], e["n"], e["at"])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(e), -1).T.tobytes() for c in columns]
    return len(e).to_bytes(8, "little") + zstandard.compress(b"".join(planes), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    n, e = int.from_bytes(raw[:8], "little"), None
    data, e, at = np.frombuffer(zstandard.decompress(raw[8:]), np.uint8), np.zeros(n, _ENTRY), 0
    for name, kind in (("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")):
        width = np.dtype(kind).itemsize
        plane = np.ascontiguousarray(data[at : at + width * n].reshape(width, n).T).view(kind).ravel()
        e[name] = np.cumsum(plane, dtype=np.uint64) if name == "token" else plane
        at += width * n
    return e


LIST_TYPE = "token long, doc long, n int, at int"


def _lists(frame: pd.DataFrame) -> pd.DataFrame:
    """Inverted lists of two sets or more."""
    e = np.concatenate([_unpacked(b) for b in frame["entries"]])
    order = np.argsort(e["token"], kind="stable")
    same = e["token"][order][1:] == e["token"][order][:-1]
    e = e[order[np.append(False, same) | np.append(same, False)]]
    return pd.DataFrame({"token": e["token"].view(np.int64), "doc": e["doc"], "n": e["n"], "at": e["at"]})


PAIR_TYPE = "a long, b long, shared long, na int, nb int"


def _cross_pairs(percent: int, block: int = 256):
    """Pairs of one list and unlike groups that size, position and the leaders' answers leave open."""
    def open_pairs(n, at, comp, near, beyond, chief, same_chief):
        """(i, j) of rows sorted by n; near, beyond: what is shared with the chief, and what is shared with others beyond it."""
        for lo in range(0, len(n), block):
            hi = min(len(n), lo + block)
            for low in range(lo, len(n), block):
                top = min(len(n), low + block)
                if 100 * n[hi - 1] < percent * n[low]:  # the rest of the list is too large for all of this block
                    break
                i, j = np.arange(lo, hi)[:, None], np.arange(low, top)[None, :]
                need = required(n[i], n[j], percent)
                room = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
                # linked sets share `few` tokens within so many first ones of either
                few = np.minimum(1 + np.minimum(n[i], n[j]) // 25, need - np.maximum(-(-percent * n[i] // 100), -(-percent * n[j] // 100)) + 1)
                early = (at[i] < n[i] - need + few) & (at[j] < n[j] - need + few)
                left = early & (i < j) & (comp[i] != comp[j]) & (room >= need)
                if same_chief:
                    left &= np.minimum(near[i], near[j]) + np.minimum(beyond[i], beyond[j]) >= need
                else:
                    left &= (chief[i] != chief[j]) | (chief[i] < 0)
                i, j = np.nonzero(left)
                yield lo + i, low + j

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["token", "n", "doc"], kind="stable")
        cuts = np.flatnonzero(np.diff(frame["token"].to_numpy(), prepend=frame["token"].iloc[0] - 1))
        doc, *columns = (frame[c].to_numpy() for c in ("doc", "n", "at", "component", "overlap", "beyond", "chief"))
        n, _, _, near, beyond, chief = columns
        # a set that falls short of its own share links with no other set of its chief
        alive = 100 * (near + beyond) >= percent * n
        found = []
        for a, z in zip(cuts, [*cuts[1:], len(doc)]):
            own = np.arange(a, z)
            groups = np.unique(chief[own])
            parts = [(own[(chief[own] == g) & alive[own]], True) for g in groups if g >= 0]
            if len(groups) > 1 or groups[0] < 0:
                parts.append((own, False))
            for rows, same_chief in parts:
                for i, j in open_pairs(*(c[rows] for c in columns), same_chief):
                    if len(i):
                        i, j = rows[i], rows[j]
                        found.append(np.column_stack([doc[i], doc[j], n[i], n[j]]))
        if not found:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "shared", "na", "nb")})
        p = np.concatenate(found)
        swap = p[:, 0] > p[:, 1]
        p[swap] = p[swap][:, [1, 0, 3, 2]]
        p, shared = np.unique(p, axis=0, return_counts=True)
        return pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "shared": shared, "na": p[:, 2].astype(np.int32), "nb": p[:, 3].astype(np.int32)})

    return run


def verified(docs: DataFrame, pairs: DataFrame, size: int, salts: int = 64, most_sent: int = 2_000_000, per_part: int = 2000) -> DataFrame:
    """(a, b, overlap, beyond) of pairs (a, b, hub), exactly: sets travel once to each group of pairs of one `a`; staged.

    `pairs` must be staged. The members of an `a` are spread over `salts` groups, so a set that leads a third
    of all sets holds up no task. `beyond` has b's elements that a lacks, where `hub` is set. Ids of the sets wanted
    are sent to all tasks up to most_sent of them, eight bytes each.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")
    member = pairs.select(F.col("b").alias("doc"), F.col("a").alias("lead"), salt.alias("salt"), F.lit(False).alias("leads"), "hub")
    leads = pairs.select(F.col("a").alias("doc"), F.col("a").alias("lead"), salt.alias("salt"), F.lit(True).alias("leads"), F.lit(False).alias("hub")).distinct()
    wanted = staged(member.union(leads), "wanted")
    some = staged(wanted.select(F.col("doc").alias("doc_id")).distinct(), "some")
    small = some.count() <= most_sent  # few enough ids to send: only their texts leave the scan
    chosen = docs.join(F.broadcast(some) if small else some, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [s.astype("<u8").tobytes() for _, _, data, offsets in text_pieces(batch.column(1)) for s in shingle_sets(data, offsets, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["doc", "tokens"])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        leads, heads, hubs = (frame[c].to_numpy() for c in ("lead", "leads", "hub"))
        sets = [np.frombuffer(t, "<u8") for t in frame["tokens"]]
        base = {leads[i]: sets[i] for i in np.flatnonzero(heads)}
        out = []
        for i in np.flatnonzero(~heads):
            if (lead := base.get(leads[i])) is not None:
                at = np.minimum(np.searchsorted(lead, sets[i]), len(lead) - 1)
                same = lead[at] == sets[i]
                out.append((leads[i], frame["doc"].iat[i], int(same.sum()), sets[i][~same].tobytes() if hubs[i] else None))
        return pd.DataFrame(out, columns=["a", "b", "overlap", "beyond"]).astype({"a": "int64", "b": "int64", "overlap": "int64"})

    held = texts(chosen).mapInArrow(sets, "doc long, tokens binary").dropDuplicates(["doc"])
    parts = max(8, -(-wanted.count() // per_part))
    sent = held.join(wanted, "doc").select("doc", "tokens", "lead", "leads", "hub", F.pmod(F.xxhash64("lead", "salt"), F.lit(parts)).alias("part"))
    out = staged(sent.groupBy("part").applyInPandas(compare, "a long, b long, overlap long, beyond binary"), "answers")
    for table in (wanted, some):
        drop_staged(table)
    return out


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chief, doc, token) for each element that a set has beyond its chief."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            some = batch.slice(at, 2000)
            tokens = [np.frombuffer(b, "<i8") for b in some.column(2).to_pylist()]
            sizes = np.array([len(t) for t in tokens])
            columns = [np.repeat(some.column(k).to_numpy(), sizes) for k in (0, 1)] + [np.concatenate(tokens)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["chief", "doc", "token"])


def _to_common_chiefs(lists: DataFrame, answers: DataFrame, hub: int) -> DataFrame:
    """(a, b, hub): sets b of lists in which another chief a was compared with more sets than their own, over `hub` of them."""
    fans = answers.groupBy("a").agg(F.count("*").alias("fans")).where(F.col("fans") > hub)
    own = answers.select(F.col("b").alias("doc"), F.col("a").alias("chief")).join(fans.withColumnRenamed("a", "chief"), "chief")
    best = lists.select("token", "doc").join(own, "doc").groupBy("token").agg(F.max(F.struct("fans", "chief")).alias("top"))
    wish = lists.select("token", "doc").join(best, "token").groupBy("doc").agg(F.max("top").alias("top"))
    now = answers.select(F.col("b").alias("doc"), F.col("a").alias("chief"))
    moved = wish.join(now, "doc").where((F.col("chief") != F.col("top.chief")) & (F.col("doc") != F.col("top.chief")))
    return moved.select(F.col("top.chief").alias("a"), F.col("doc").alias("b"), F.lit(True).alias("hub"))


def answers_of_chiefs(answers: DataFrame, sized: DataFrame) -> DataFrame:
    """(doc, chief, overlap, beyond): for each set that was compared with a chief, and each chief, what it shares with the chief, and how much
    beyond the chief it can share with another set of the same chief: what any other has too, known for large groups."""
    own = answers.select(F.col("a").alias("doc")).distinct().join(answers.select(F.col("b").alias("doc")), "doc", "left_anti")
    chiefs = own.join(sized, F.col("doc") == F.col("id")).select("doc", F.col("doc").alias("chief"), F.col("size").alias("overlap"), F.lit(0).cast("long").alias("beyond"))
    each = answers.where("beyond is not null").select(F.col("a").alias("chief"), F.col("b").alias("doc"), "beyond").mapInArrow(_apart, "chief long, doc long, token long")
    common = each.groupBy("chief", "token").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    alike = each.join(common, ["chief", "token"]).groupBy("doc").agg(F.count("*").alias("alike"))
    told = answers.join(alike, F.col("b") == F.col("doc"), "left").join(sized, F.col("b") == F.col("id"))
    beyond = F.when(F.col("beyond").isNull(), F.col("size") - F.col("overlap")).otherwise(F.coalesce("alike", F.lit(0))).cast("long")
    return told.select(F.col("b").alias("doc"), F.col("a").alias("chief"), "overlap", beyond.alias("beyond")).union(chiefs)


def components(docs: DataFrame, size: int = 5, percent: int = 80, per_bucket: int = 1_000_000, hub: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every document.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct word
    shingles (A-Z lower-cased). A document of fewer words has one shingle of all its words; null, empty and
    wordless texts have none and link with nothing, as do rows with a null id. Rows that repeat an id are told
    apart only by their sets: each keeps its own size, and they share a component. Texts are read whole, however
    long. Other columns are ignored; an empty table gives no rows. Groups of over `hub` sets that met one chief have their answers derived from its.
    """
    spark = docs.sparkSession
    slim = texts(docs)
    prints = staged(slim.mapInArrow(_fingerprints(size), "doc_id long, n long, fp1 long, fp2 long, slice int, counts binary"), "prints")
    sets = prints.where("slice is null")
    classes = staged(sets.where("n > 0 and doc_id is not null").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    per_set = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    tokens = classes.agg(F.sum(per_set)).first()[0] or 0
    shared = spark.sparkContext.broadcast(_rarity(prints))

    shown = slim.where("doc_id is not null").mapInArrow(_prefixes(shared, size, percent), "doc_id long, n long, prefix binary")
    single = shown.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    buckets = max(1, -(-int(tokens) // per_bucket))
    entries = single.mapInArrow(_to_lists(buckets), "bucket int, entries binary")
    lists = staged(entries.groupBy("bucket").applyInPandas(_lists, LIST_TYPE), "lists")

    # each set against the leader it meets oftenest
    listed = lists.groupBy("doc").agg((F.count("*") / F.first(per_set)).alias("part"))
    rank = F.struct("part", F.xxhash64("doc").alias("draw"), F.col("doc").alias("leader"))
    leads = lists.join(listed, "doc").groupBy("token").agg(F.max(rank).alias("top")).select("token", "top.leader")
    met = lists.join(leads, "token").where("doc <> leader").groupBy("doc", "leader").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    best = met.groupBy("doc").agg(F.max(F.struct("times", F.col("leader").alias("lead"), "n")).alias("x")).where(F.col("x.times") * 16 >= F.col("x.n"))
    tried = best.select(F.col("x.lead").alias("a"), F.col("doc").alias("b"))
    many = tried.groupBy("a").agg((F.count("*") > hub).alias("hub"))
    tried = staged(tried.join(many, "a"), "tried")
    answers = verified(slim, tried, size)
    sized = classes.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("size"))
    # where sets of one list have several chiefs, they are compared with the one that most sets were
    moved = staged(_to_common_chiefs(lists, answers, hub), "moved")
    again = verified(slim, moved, size)
    linked = _linked(answers.unionByName(again), sized, percent)
    settled = connected(linked)
    answers_now = answers.join(again.select("b"), "b", "left_anti").unionByName(again)

    # pairs of unlike groups that some list holds
    known = answers_of_chiefs(answers_now, sized)
    told = lists.join(settled.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed_lists = told.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    open_lists = told.join(mixed_lists, "token", "left_semi").join(known, "doc", "left")
    open_lists = open_lists.select("token", "doc", "n", "at", "component", F.coalesce("overlap", F.lit(0)).alias("overlap"), F.coalesce("beyond", "n").cast("long").alias("beyond"), F.coalesce("chief", F.lit(-1)).alias("chief"), F.pmod(F.xxhash64("token"), F.lit(max(buckets, 8))).alias("part"))
    pairs = open_lists.groupBy("part").applyInPandas(_cross_pairs(percent), PAIR_TYPE)
    counted = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    most = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)) - F.greatest(*(F.ceil(F.col(c) * percent / 100) - 1 for c in ("na", "nb")))
    need = F.least(1 + F.floor(F.least("na", "nb") / 25), most)
    checked = staged(counted.where(F.col("shared") >= need).select("a", "b", F.lit(False).alias("hub")), "checked")
    late = verified(slim, checked, size)
    more = _linked(late, sized, percent)
    whole = connected(linked.union(more))

    alike = classes.join(whole, F.col("rep") == F.col("node"), "left").select("n", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(alike, ["n", "fp1", "fp2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = staged(out, "components")
    for table in (prints, classes, lists, tried, answers, moved, again, linked, settled, checked, late, more, whole):
        drop_staged(table)
    return out


def _linked(answers: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    with_sizes = answers.join(sized.select(F.col("id").alias("a"), F.col("size").alias("na")), "a").join(sized.select(F.col("id").alias("b"), F.col("size").alias("nb")), "b")
    return staged(with_sizes.where(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).select("a", "b"), "links")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, most_sent: int = 2_000_000) -> DataFrame:
    """The documents whose id is the least of their group, with all their columns."""
    groups = components(docs, size, percent)
    gone = staged(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= most_sent else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
