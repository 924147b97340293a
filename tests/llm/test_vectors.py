"""Clustering, vector codes and web archives against brute force, with nulls, ties, repeats, empty tables and odd columns."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import centroids, codes, queries, vectors, warc

TYPE = "vec_id long, embedding array<float>, label int, code string, k int, cluster_inertia long"


def made(n, seed, spread=1.0, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)) * spread
    return np.round(x * grid) / grid if grid else x


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in row], i % 3 if i % 7 else None, "c", 1, 2) for i, row in enumerate(x)]


#: Plain vectors, exact repeats, and vectors of so few values that many distances tie.
CLEAN = rows_of(np.concatenate([made(260, 1), made(1, 2).repeat(40, 0), made(120, 3, 0.02, 64), made(30, 4, 40.0)])) + [(5, [0.25] * 64, 1, "c", 1, 2), (5, [0.5] * 64, 1, "c", 1, 2)]
BROKEN = [(900, None, 0, "c", 1, 2), (901, [], 0, "c", 1, 2), (902, [1.0] * 63, 0, "c", 1, 2), (903, [1.0] * 63 + [None], 0, "c", 1, 2), (904, [1.0] * 63 + [math.nan], 0, "c", 1, 2), (905, [math.inf] + [1.0] * 63, 0, "c", 1, 2), (906, [1.0] * 65, 0, "c", 1, 2)]


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, TYPE).repartition(parts)


def ints(row, scale):
    return [math.floor(float(np.float32(v)) * scale) for v in row[1]]


def lloyd(x, c, rounds):
    """Plain rounds in Python integers: [(number, squared distance)] and the last centroids."""
    x, c = np.array(x, object), np.array(c, object)

    def assign():
        d = np.array([[((a - b) ** 2).sum() for b in c] for a in x], object)
        return [(int(np.argmin(r)), int(min(r))) for r in d]

    for _ in range(rounds):
        near = np.array([k for k, _ in assign()])
        for k in range(len(c)):
            if (near == k).any():
                c[k] = [int(s) // int((near == k).sum()) for s in x[near == k].sum(axis=0)]
    return assign(), c.tolist()


def test_clusters_are_those_of_plain_rounds(spark):
    got = centroids.cluster(table(spark, CLEAN + BROKEN), rounds=3)
    x = [ints(r, 64) for r in CLEAN]
    order = sorted(range(len(CLEAN)), key=lambda i: (hashlib.sha256(f"1:{CLEAN[i][0]}".encode()).hexdigest(), x[i]))
    near, last = lloyd(x, [x[i] for i in order[:16]], 3)
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    per = {k: sum(d for j, d in near if j == k) for k, _ in near}
    want = sorted((r[0], k, d, per[k], sum(per.values()), prints[k]) for r, (k, d) in zip(CLEAN, near))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert got.schema == centroids.cluster(table(spark, BROKEN)).schema and centroids.cluster(table(spark, BROKEN)).count() == 0


def test_clusters_of_few_vectors_and_null_ids(spark):
    got = centroids.cluster(table(spark, [(None, [1.0] * 64, 0, "c", 1, 2), *CLEAN[:3]]), clusters=16).collect()
    assert len(got) == 4 and {r["distance"] for r in got} == {0} and sorted(r["cluster"] for r in got) == [0, 1, 2, 3]
    assert [r["cluster"] for r in got if r["vec_id"] is None] == [3]
    assert centroids.cluster(table(spark, CLEAN).where("false")).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(table(spark, [(1, [2e6] * 64, 0, "c", 1, 2)]), rounds=1).count()


@pytest.mark.parametrize("seed", range(6))
def test_annulus_holds_the_nearest(seed):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-4 - seed, 4, (500, 8)), rng.integers(-3, 4 + 50 * (seed % 2), (1 + 7 * seed, 8))
    c[-1] = c[0]
    d = vectors.all_apart(x, c)
    who, best = centroids.nearest(x, c)
    assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_are_those_of_plain_rounds(spark):
    got = codes.encode(table(spark, CLEAN + BROKEN), entries=20, rounds=4)
    x = np.array([ints(r, 1024) for r in CLEAN], object)
    order = sorted(range(len(CLEAN)), key=lambda i: (CLEAN[i][0], np.array(x[i], "<i4").tobytes()))
    each = [lloyd(x[:, 16 * p : 16 * p + 16], x[order[:20], 16 * p : 16 * p + 16], 4) for p in range(4)]
    digest = hashlib.sha256(",".join(str(v) for _, book in each for entry in book for v in entry).encode()).hexdigest()
    error = [sum(near[i][1] for near, _ in each) for i in range(len(CLEAN))]
    label = {k: sum(e for r, e in zip(CLEAN, error) if r[2] == k) for k in {r[2] for r in CLEAN}}
    want = sorted((r[0], "".join(f"{near[i][0]:02x}" for near, _ in each), error[i], label[r[2]], digest) for i, r in enumerate(CLEAN))
    assert sorted(tuple(r)[:5] for r in got.collect()) == want
    assert codes.encode(table(spark, BROKEN)).schema.fieldNames() == got.schema.fieldNames() and codes.encode(table(spark, BROKEN)).count() == 0
    with pytest.raises(ValueError):
        codes.encode(table(spark, CLEAN), entries=257)


@pytest.mark.parametrize("seed,unit", [(0, 1), (1, 1), (2, 4), (3, 64)])
def test_bounds_hold_and_prune(seed, unit):
    """After moves of the entries, bounds are still bounds, the nearest are found, and most distances aren't taken."""
    rng = np.random.default_rng(seed)
    heart = rng.integers(-2000, 2000, (32, 16))
    x = heart[rng.integers(0, 32, 600)] + rng.integers(-90, 90, (600, 16))
    x[:50] = x[50:100]
    entries = np.concatenate([heart[:30] + 5, heart[:2] + 5])
    own, upper, lower = codes.first_bounds(x, entries, unit)
    taken = 0
    for _ in range(4):
        later = entries + rng.integers(-9, 10, entries.shape) * (rng.random((len(entries), 1)) < 0.5)
        moves = vectors.root_up(vectors.apart(entries, later))
        entries = later
        own, upper, lower, n = codes.tightened(x, entries, vectors.root_down(vectors.all_apart(entries, entries)), moves, own, upper, lower, unit)
        d = vectors.all_apart(x, entries)
        assert (own == d.argmin(axis=1)).all()
        assert ((lower.astype(np.int64) * unit) ** 2 <= d).all() and (upper**2 >= d[np.arange(len(x)), own]).all()
        taken += n
    assert taken < 0.5 * 4 * d.size


def test_large_components_are_exact():
    x = np.array([[2**25, -(2**25)], [2**25 - 1, 3]], np.int64)
    assert vectors.all_apart(x, x).tolist() == [[0, 1 + (2**25 + 3) ** 2], [1 + (2**25 + 3) ** 2, 0]]
    squares = np.array([0, 1, 2, 3, 4, (2**29 - 1) ** 2 - 1, (2**29 - 1) ** 2, 2**58 - 1], np.int64)
    assert vectors.root_down(squares).tolist() == [math.isqrt(int(v)) for v in squares]
    few = squares[:5]
    assert vectors.root_down(few).tolist() == [0, 1, 1, 1, 2] and vectors.root_up(few).tolist() == [0, 1, 2, 2, 2]
    assert vectors.root_down(np.array([(2**26 - 1) ** 2 - 1, (2**26 - 1) ** 2])).tolist() == [2**26 - 2, 2**26 - 1]
    assert vectors.root_up(squares).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in squares]


RNG = random.Random(5)
LONG = "".join(RNG.choice("abcdefgh <>é\r\n") for _ in range(300_000))
PAGES = [
    (4, "http://a.example/1", "x" * 100), (2, "http://a.example/2", "x" * 100), (9, None, "x" * 100), (9, "http://b.example/", "x" * 100), (7, "http://c.example/\r\nEvil: 1 ü", "é" * 50),
    (8, "http://c.example/", "é" * 50), (1, "u", "é" * 49), (3, "u", "é" * 49), (10, "u", None), (11, "u", ""), (12, "u", LONG), (13, "u", LONG), (None, "u", "x" * 100), (None, "u", "y" * 100), (None, None, "y" * 100), (-3, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "z", 3, 4) for r in PAGES], "page_id long, url string, html string, digest string, part int, payload int").repartition(5)


def roles():
    """(page_id, bytes, digest, type, refers_to) of PAGES by plain search; None sorts last."""
    out, responses = [], {}
    for page_id, _, html in sorted(PAGES, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        led = len(raw) >= 100 and raw in responses
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if led else "response", responses[raw] if led else None))
        responses.setdefault(raw, page_id)
    return out


def some(rows):
    return sorted(rows, key=repr)


def test_archive_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/archive"
    files = {r["name"]: r for r in warc.write_archive(pages, folder, roll=2000).collect()}
    got = warc.read_archive(spark, folder, payloads=True).collect()
    assert some((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == some(roles())
    kept = some((r["page_id"], bytes(r["payload"])) for r in got if r["payload"] is not None)
    assert kept == some((i, next((h or "").encode() for p, _, h in PAGES if p == i and hashlib.sha256((h or "").encode()).hexdigest() == d)) for i, _, d, kind, _ in roles() if kind == "response")
    assert {r["url"] for r in got if r["page_id"] == 7} == {"http://c.example/%0D%0AEvil:%201 ü".replace(" ", "%20")} and [r["url"] for r in got if r["page_id"] == -3] == ["u"]
    assert len(files) > 1 and {p.name for p in (tmp_path / "archive").glob("*.gz")} == set(files) and not (tmp_path / "archive/.tmp").exists()
    before = 0
    for name in sorted(files):
        raw = (tmp_path / "archive" / name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (files[name]["bytes"], files[name]["sha256"])
        members = gzip.decompress(raw)  # any gzip reader takes the file
        assert members.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and members.endswith(b"\r\n\r\n")
        assert files[name]["file"] >= before
        before = files[name]["file"]
    assert sum(r["records"] for r in files.values()) == len(PAGES)


def test_archive_is_the_same_bytes_from_any_partitions(spark, pages, tmp_path):
    one = warc.write_archive(pages.coalesce(1), f"file://{tmp_path}/one", roll=3000, per_part=1 << 30)
    many = warc.write_archive(pages.repartition(11), f"file://{tmp_path}/many", roll=3000, per_part=1000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_archive_of_nothing(spark, pages, tmp_path):
    assert warc.write_archive(pages.where("false"), f"file://{tmp_path}/none").count() == 0
    assert warc.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def test_damage_is_found(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/bad"
    warc.write_archive(pages, folder)
    file = next((tmp_path / "bad").glob("*.gz"))
    whole = file.read_bytes()
    raw = gzip.decompress(whole)
    for broken in (whole[:-40], gzip.compress(raw.replace(b"xxxxx", b"xxxxz", 1)), gzip.compress(raw[:400])):
        file.write_bytes(broken)
        with pytest.raises(Exception):
            warc.read_archive(spark, folder).count()
    with pytest.raises(Exception):
        warc.write_archive(pages, folder)  # a committed archive isn't written again


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_codes", "op13_warc"])
def test_queries_match_sql(spark, name, tmp_path):
    """The registered queries on sf0.001 with a copied page, a null vector and a copied vector, against DuckDB."""
    import duckdb

    root = "/root/testdata/sf0.001"
    vec = spark.read.parquet(f"{root}/embeddings.parquet")
    vec = vec.union(vec.where("vec_id < 9").selectExpr("vec_id + 100000", "embedding", "cast(null as int)")).union(vec.limit(1).selectExpr("-1L", "cast(null as array<float>)", "label"))
    vec.coalesce(2).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    page = spark.read.parquet(f"{root}/pages.parquet")
    page.union(page.where("page_id % 4 = 1").selectExpr("page_id + 100000", "url", "html")).union(page.limit(1).selectExpr("-1L", "cast(null as string)", "cast(null as string)")).coalesce(2).write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, f"file://{tmp_path}")
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert some(map(tuple, got.select(*want.columns).collect())) == some(want.fetchall())


def test_unused_entries_and_clusters_stay(spark):
    """Copies among the seeds: the later one is never nearest and keeps its place."""
    rows = [(i, [float(i // 2)] * 64, 0, "c", 1, 2) for i in range(8)]
    got = codes.encode(table(spark, rows), entries=8).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == [f"{i // 2 * 2:02x}" * 4 for i in range(8)] and {r["error"] for r in got} == {0}
    done = centroids.cluster(table(spark, rows), clusters=8)
    assert done.select("cluster").distinct().count() == 4 and done.agg(F.max("distance")).first()[0] == 0
