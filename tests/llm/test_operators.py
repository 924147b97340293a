"""Each text operator against a brute-force version, on a table with nulls, empty and repeated rows and odd columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import chat, decontamination, jaccard, language, lines, packing, quality, sharding, suffixes, toxicity

RNG = random.Random(11)
WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet", "kilo", "lima"]


def prose(n):
    return " ".join(RNG.choice(WORDS) + str(RNG.randrange(40)) for _ in range(n))


BASE = [prose(60) for _ in range(8)]
TEXTS = [
    *BASE, BASE[0], BASE[0], BASE[1].replace("alpha", "ALPHA"), BASE[2] + " tail", prose(10) + " " + BASE[3][30:200] + " " + prose(9),
    "", None, None, "one", "one two three", "a\nb\na\n\nA b c d\n" + BASE[4], "x " * 3000, "é" * 120, "shared line of some words here\n" + prose(30), "Shared line, of some words here!\n" + prose(20),
    "\n".join([prose(12), "the quick brown fox jumps over the lazy dog again and again today", prose(9)]), "the quick brown fox jumps over the lazy cat again and again today\n" + prose(8), " \t\n ", "###$$$ %%% &&&",
]
DOCS = [(i * 3 + 1, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), 5, "z") for i, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, word string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sharding(docs, empty):
    tree = sharding.HashTree.even(40)
    got = by_id(sharding.assign_shards(docs, tree, tree.with_shard()))
    assert len(got) == len(DOCS)
    for i, t in DOCS:
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert got[i]["grown_shard"] in (got[i]["shard"], 40)
    for s in {r["shard"] for r in got.values()}:
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.assign_shards(empty, tree).count() == 0


def test_sharding_moves_only_where_weights_change(spark):
    tree = sharding.HashTree.even(40)
    heavier = tree.with_weight(7, 3.0)
    ids = spark.range(20_000)
    moved = ids.select(tree.place(F.col("id")).alias("a"), heavier.place(F.col("id")).alias("b"), tree.with_shard().place(F.col("id")).alias("c"))
    region = {s: g for s, g, _, _ in tree.leaves}
    for r in moved.where("a <> b").collect():
        assert region[r["b"]] == region[7]
    assert moved.where("a <> c and c <> 40").count() == 0
    share = moved.groupBy("a").count().agg(F.min("count"), F.max("count")).first()
    assert share[0] > 350 and share[1] < 650


def test_suffix_dedup(docs, empty):
    got = by_id(suffixes.remove_repeats(docs, with_bytes=True))
    seen = set()
    for i, t in sorted(DOCS):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(own)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), int(gone.sum()), spans), i
        assert bytes(got[i]["kept"]) == kept and got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_anchors_take_a_row_a_bucket():
    """Not one a bucket and batch, of which there are more than anchors in large inputs; what two documents hold is found all the same."""
    rng = np.random.default_rng(8)
    said = [rng.integers(97, 123, 400, np.uint8).tobytes().decode() for _ in range(60)]
    said += [said[i][:200] + rng.integers(97, 123, 100, np.uint8).tobytes().decode() for i in range(0, 60, 3)] + said[:4]
    home = np.arange(len(said), dtype=np.int32) % 50
    piece = lambda a, b: pa.RecordBatch.from_arrays([pa.array(home[a:b]), pa.array(said[a:b])], ["batch", "text"])
    rows = pa.Table.from_batches(list(suffixes._anchor_rows(7)(iter([piece(0, 50), piece(50, len(said))])))).to_pandas()
    assert len(rows) == 2 * 7
    held, want = {}, {}
    for i, t in enumerate(said):
        for h in set(suffixes.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1].tolist()):
            held.setdefault(h, []).append(int(home[i]))
    for h, homes in held.items():
        for b in set(homes) if len(homes) > 1 else ():
            want.setdefault((b, h % 7), set()).add(h)
    notes = [r for _, frame in rows.groupby("bucket") for r in suffixes._shared_anchors(frame).itertuples()]
    assert {(r.batch, r.bucket): set(suffixes._unpacked(r.data).tolist()) for r in notes} == want and want


def test_interleave_is_a_stable_merge():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 3, (n, 4)).astype(np.uint64) for n in (40, 1, 25)]
    parts = [p[np.lexsort(p.T[::-1])] for p in parts]
    rows = np.concatenate(parts)
    assert (suffixes.interleave(rows) == np.lexsort((np.arange(len(rows)), *rows.T[::-1]))).all()


def test_line_dedup(docs, empty):
    got = by_id(lines.dedup_lines(docs))
    first, gone = {}, Counter()
    for i, t in sorted(DOCS):
        for line in (t or "").split("\n"):
            w = tuple(line.lower().split())
            if sum(c.isalpha() for c in line) >= 10 and first.setdefault(w, (i, line)) != (i, line) and first[w][0] != i:
                gone[i] += 1
    for i, t in DOCS:
        assert got[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
        assert got[i]["n_removed"] >= gone[i]
    assert "Shared line" not in got[DOCS[22][0]]["text"] and "shared line" in got[DOCS[21][0]]["text"]
    assert got[DOCS[14][0]]["text"] is None and lines.dedup_lines(empty).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_verifies_characters(spark):
    said = ["Subscribe to our newsletter", "Subscribe to our newsleter", "Subscribe to our competitor"]
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(3)] == [0, 1, 0]


@pytest.mark.parametrize("n", [1, 2, 7, 126, 127, 128, 400, 40_000])
def test_simhash_counts_every_word_once(spark, n):
    words = [f"w{k % max(1, n - n // 10)}x" for k in range(n)]
    df = spark.createDataFrame([(words,)], "words array<string>")
    got = df.select(lines.simhash(F.col("words")).alias("s"), F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("h")).first()
    want = sum((sum(h >> j & 1 for h in got["h"]) * 2 > len(got["h"])) << j for j in range(64))
    assert got["s"] & (1 << 64) - 1 == want


def test_line_dedup_of_long_lines(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    w = [word() for _ in range(600)]
    some = lambda k: [word() if i % k == 0 else x for i, x in enumerate(w)]
    said = [w, some(10), some(3), [*w[:300], *(word() for _ in range(300))]]
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(said)], "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(4)] == [0, 1, 0, 0]


def test_line_dedup_in_large_groups(spark):
    """Seventy unlike lines around one common passage stay; near copies of one line go, however many."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage = [word() for _ in range(14)]
    said = [" ".join([word() for _ in range(8)] + passage + [word() for _ in range(8)]) for _ in range(70)]
    base = [word() for _ in range(25)]
    near = []
    for _ in range(70):
        w = list(base)
        for at in rng.sample(range(25), 2):
            w[at] = word()
        near.append(" ".join(w))
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(said + near)], "doc_id long, text string")))
    assert sum(got[i]["n_removed"] for i in range(70)) == 0
    assert sum(got[i]["n_removed"] for i in range(70, 140)) == 69


@pytest.mark.parametrize("words,shared,many", [(24, 10, 150), (40, 30, 150), (14, 6, 1200)])
def test_line_dedup_recall_around_boilerplate(spark, words, shared, many):
    """Pairs with one word changed, all around a passage whose words sort last: nine of ten go at least, and unlike lines stay."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    passage = ["z" + word() for _ in range(shared)]
    said = []
    for _ in range(many):
        own = [word() for _ in range(words - shared)]
        other = list(own)
        other[rng.randrange(len(own))] = word()
        cut = rng.randrange(len(own))
        said += [" ".join(own[:cut] + passage + own[cut:]), " ".join(other[:cut] + passage + other[cut:])]
    alike_by_passage = words * 0.8 <= shared + 1  # mostly passage: lines of unlike pairs may be alike too
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(said)], "doc_id long, text string, _own string, _gone int")))
    gone = [got[2 * i + 1]["n_removed"] for i in range(many)]
    assert sum(gone) >= 0.9 * many, sum(gone)
    assert alike_by_passage or sum(got[2 * i]["n_removed"] for i in range(many)) == 0


def test_line_dedup_of_lines_whose_runs_all_are_common(spark):
    """Lines of two passages each, every one of them in thirty lines or more: those whose first passage is another's but for three words go, all of them, and no others."""
    rng = random.Random(53)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    first, second = ([[word() for _ in range(12)] for _ in range(30)] for _ in range(2))
    first += [[*p[:9], word(), word(), word()] for p in first[:5]]
    said = [" ".join(p + q) for p in first for q in second]
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(len(said))] == [0] * 900 + [1] * 150


def test_line_dedup_of_repeated_words(spark):
    """Long lines go whose repeated words stay and whose others change, also where they share but one run."""
    rng = random.Random(59)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    common = ["zw", "zx", "zy", "zz"] * 12
    said = []
    for _ in range(12):
        said += [" ".join(common + [x for _ in range(18) for x in (word(), "zw", "zx")]) for _ in range(2)]
    one_run = [" ".join([word() for _ in range(3)] + ["zz", "zx"] * 80) for _ in range(2)]
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(said + one_run)], "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(26)] == [0] + [1] * 23 + [0, 1]


def test_line_dedup_of_long_lines_by_words_of_any_length(spark):
    """Long lines with a tenth of their words changed go where the changed words are long, where a script sets no spaces, and where spaces repeat; alone and in a group of forty."""
    rng = random.Random(67)
    word = lambda k=5: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    passage = ["z" + word() for _ in range(24)]
    said = []
    for shared in [[], *[passage] * 20]:
        w = shared + [word() for _ in range(60 - len(shared))]
        said += [" ".join(w), " ".join(word(60) if i % 10 == 9 and i >= 24 or not shared and i % 10 == 9 else x for i, x in enumerate(w))]
    signs = [chr(0x4E00 + rng.randrange(5000)) for _ in range(400)]
    said += ["".join(signs), "".join(chr(0x4E00 + rng.randrange(5000)) if i % 20 == 0 else x for i, x in enumerate(signs))]
    short = [word() for _ in range(12)]
    said += [" ".join(short), (" " * 9).join([*short[:11], word()])]
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")))
    assert [got[i]["n_removed"] for i in range(len(said))] == [0, 1] * (len(said) // 2)


def test_line_dedup_leaves_no_shuffle_files(spark, docs):
    """Every step's shuffle files are gone when it has ended, without a collection of garbage, and the session's setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    files = lambda: {f.getName() for f in conv.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    disk, conv = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark._jvm.scala.jdk.javaapi.CollectionConverters
    before = files()
    lines.repeated_lines(docs.select("doc_id", "text"))
    for _ in range(50):  # files go in the background
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(name) == kept


@pytest.mark.parametrize("most_sent", [0, 32_000_000])
def test_line_texts_once_a_class(spark, most_sent):
    """Lines found again in texts have the ids they were cut with, once each, also where rows repeat id and text."""
    rng = random.Random(71)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(6))
    said = [" ".join(word() for _ in range(n)) for n in (3, 12, 80)] + ["  Two\twords  HERE again ", "字" * 40, "字" * 400]
    df = spark.createDataFrame([(1, "\n".join(said)), (2, "\n".join(said[::-1])), (2, "\n".join(said[::-1]))], "doc_id long, text string")
    cut = lines.line_rows(df, 1)
    got = {r["id"]: r for r in lines.line_texts(df, cut.where("doc_id = 2").select("doc_id", "row", "line").distinct(), 0.8, most_sent).collect()}
    assert len(got) == len(said) and set(got) == {r["id"] for r in cut.collect()}
    assert all((got[r["id"]]["spelt"] is None) == (r["n"] < lines.LONG) for r in cut.collect())
    assert lines.line_texts(df, cut.select("doc_id", "row", "line"), 0.8, most_sent).count() == len(said)


def test_line_dedup_of_few_long_words(spark):
    said = ["本网站使用缓存以改善您的体验", "ok", "Impressum Datenschutz", "yes no", "--- --- --- ---", "12 34 56 78 90"]
    got = by_id(lines.dedup_lines(spark.createDataFrame([(i, "\n".join(said)) for i in range(2)], "doc_id long, text string")))
    assert got[0]["n_removed"] == 0 and got[1]["text"] == "ok\nyes no\n--- --- --- ---\n12 34 56 78 90"


def test_line_dedup_recall_of_changed_words(spark):
    """Lines of 4 to 50 words with up to a tenth of them changed, one at least, or one added: all that are alike by force go."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    said = []
    for n in (4, 5, 6, 8, 10, 15, 20, 35, 50):
        for k in {1, max(1, n // 10)}:
            for _ in range(6):
                w = [word() for _ in range(n)]
                v = list(w)
                for at in rng.sample(range(n), k):
                    v[at] = v[at][:-1] + "é" if n < 6 else word()
                more = list(w)
                more.insert(rng.randrange(n + 1), word())
                said += [(" ".join(w), " ".join(v)), *([(" ".join(w), " ".join(more))] if n > 5 else [])]
    rows = [(2 * i + j, t) for i, pair in enumerate(said) for j, t in enumerate(pair)]
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got[2 * i + 1]["n_removed"] for i in range(len(said))) == len(said)


def test_line_dedup_recall_against_force(spark):
    """Of pairs of lines with 0.8 to 0.95 of their characters (words, of long ones) alike, by changed, added and removed words and letters, nine of ten go at least; unlike pairs stay."""
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    pairs = []
    for n in (6, 10, 20, 35, 70):
        for share in (0.05, 0.1, 0.15, 0.2, 0.4):
            for _ in range(12):
                w = [word() for _ in range(n)]
                v = list(w)
                for at in sorted(rng.sample(range(n), max(1, round(n * share))), reverse=True):
                    what = rng.randrange(4)
                    if what == 0:
                        v[at] = word()
                    elif what == 1:
                        v.insert(at, word())
                    elif what == 2 and len(v) > 3:
                        del v[at]
                    else:
                        v[at] = v[at][:-1] + rng.choice("éxq")
                pairs.append((" ".join(w), " ".join(v)))
    units = lambda a, b: (a.split(" "), b.split(" ")) if min(len(a), len(b)) >= lines.LONG else (a, b)
    alike = [1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in (units(a, b) for a, b in pairs)]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    gone = [got[2 * i + 1]["n_removed"] for i in range(len(pairs))]
    assert all(not g for g, s in zip(gone, alike) if s < 0.8 - 1e-9)
    found = [g for g, s in zip(gone, alike) if s >= 0.8]
    assert len(found) > 150 and sum(found) >= 0.95 * len(found), (sum(found), len(found))


def test_quality_counts(spark, docs, empty):
    got = by_id(quality.measured(docs))
    for i, t in DOCS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(windows)
        repeat = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
        said = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(said) - len(set(said)), len(repeat))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
    labels = spark.createDataFrame([(i, 1) for i, _ in DOCS], "doc_id long, quality int")
    verdicts = by_id(quality.quality_verdicts(docs, labels))
    assert all(r["kept"] == (not r["base_failed"]) for r in verdicts.values())  # too few labels to certify a cutoff
    assert quality.quality_verdicts(empty, labels).count() == 0


def test_binomial_tail_is_exact(spark):
    rows = [(k, n) for n in (1, 30, 400) for k in (0, 1, 5, n) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(min(1.0, want), rel=1e-9)


def test_cutoffs_keep_to_the_risk(spark):
    rng = random.Random(3)
    rows = [("en", 100, 500, rng.choice([0] * 97 + [3, 40, 60]), 0, 0, 1) for _ in range(6000)]
    labelled = spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int")
    cut = {r["rule"]: r for r in quality.certified_cutoffs(labelled, "lang", F.col("quality") == 1).collect()}
    assert cut["symbols"]["hits"] / cut["symbols"]["trials"] < 0.0125 and cut["symbols"]["cutoff"] > 0.3


def test_rules_together_keep_to_the_risk(spark):
    """Enough labels to reject: bad documents go, and of the good ones of each stratum all rules reject the stated risk at most."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(4000):
        good = i % 4 > 0
        w = [f"w{rng.randrange(5000)}" for _ in range(60)]
        if rng.random() < (0.001 if good else 0.8):
            w = [x + "#|" for x in w]
        rows.append((i, " ".join(w), "en" if i % 3 else "de"))
        labels.append((i, int(good)))
    got = by_id(quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")))
    for lang in ("en", "de"):
        kept = {g: [got[i]["kept"] for (i, _, at), (_, x) in zip(rows, labels) if at == lang and x == g] for g in (0, 1)}
        assert np.mean(kept[1]) >= 0.95 and np.mean(kept[0]) < 0.4


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    more = docs.sparkSession.createDataFrame([(5000, "see <|endoftext|> here " * 9)], "doc_id long, text string")
    rows = packing.pack(docs.select("doc_id", "text").union(more), vocabulary()).collect()
    texts = dict(DOCS) | {5000: "see <|endoftext|> here " * 9}
    bins = {}
    for i, t in texts.items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) + 1
    assert packing.pack(empty, vocabulary()).count() == 0


def test_local_search_empties_bins():
    plan = Counter({(6, 1): 1, (4, 3): 1, (3, 3): 1})
    done = packing.local_search(plan, 10)
    assert sum(done.values()) == 2 and Counter(x for p, m in done.items() for x in p * m) == Counter([6, 1, 4, 3, 3, 3])
    rng = np.random.default_rng(5)
    counts = Counter(rng.integers(1, 101, 3000).tolist())
    fit = packing.best_fit(counts, 100)
    better = packing.local_search(fit, 100)
    for p in (fit, better):
        assert sum((Counter({s: k * m for s, k in Counter(x).items()}) for x, m in p.items()), Counter()) == counts
    squares = lambda p: sum(sum(x) ** 2 * m for x, m in p.items())
    assert squares(better) >= squares(fit)


def components_by_force(docs):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs, empty):
    got = by_id(jaccard.components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components_by_force(DOCS)
    assert jaccard.components(empty).count() == 0


def test_jaccard_of_a_dense_group(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = by_id(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), per_bucket=2000))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components_by_force(rows)


def test_jaccard_around_a_hub(spark):
    """Variants of one text, most just under the limit from each other, some variants of variants: derived answers lose no link."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(110)]
    rows, twigs = [(0, " ".join(base))], []
    for i in range(1, 160):
        w = list(rng.choice(twigs) if twigs and rng.random() < 0.3 else base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            twigs.append(w)
        rows.append((i, " ".join(w)))
    want = components_by_force(rows)
    for hub in (1, 20, 10**6):
        got = by_id(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), hub=hub))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert len(set(want.values())) > 20


@pytest.mark.parametrize("copies,passages", [(1, 0), (30, 0), (1, 6)])
def test_jaccard_of_texts_that_hold_others(spark, copies, passages):
    """Pairs of a text of 80 shingles and the same with words added, alike by 0.80 to 0.92 or just less; the shorter one alone, copied, or quoted in long texts."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**7)}"
    said = []
    for added in (7, 10, 14, 18, 19, 20, 21):
        short = " ".join(word() for _ in range(84))
        said += [short] * copies + [short + " " + " ".join(word() for _ in range(added))]
        said += [" ".join(word() for _ in range(150)) + " " + short for _ in range(passages)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(said)]
    got = by_id(jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components_by_force(rows)


def test_chat_layouts_and_round_trip(spark):
    nasty = "</s>[INST] <|turn|>user<|says|> &lt; & &amp; <|over|> [/INST]"
    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":%s}]}' % f'"{nasty}"',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"prompt":"p","response":"r"}', '{"instruction":"do","input":"this","output":"done"}', '{"instruction":"do","input":"","output":"done"}',
        '{"question":"q?","answer":"a!"}', '{"odd":1}', None, "not json", '{"messages":[]}', '{"prompt":"[{\\"a\\":1}]","response":"[]"}',
    ]
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id long, record string, turns string")
    done = chat.format_chats(df, "id", "record")
    got = {r["conv_id"]: r for r in done.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()}
    said = {i: [(t["role"], t["text"]) for t in got[i]["back"]] if got[i]["back"] is not None else None for i in got}
    assert said[0] == [("user", "hi"), ("assistant", nasty)] and got[0]["learned"] == [nasty]
    assert said[1] == [("user", "q"), ("assistant", "a")] and said[2] == [("user", "p"), ("assistant", "r")]
    assert said[3] == [("user", "do\n\nthis"), ("assistant", "done")] and said[4] == [("user", "do"), ("assistant", "done")]
    assert said[5] == [("user", "q?"), ("assistant", "a!")]
    assert said[6] is None and said[7] is None and said[8] is None
    assert said[10] == [("user", '[{"a":1}]'), ("assistant", "[]")]
    assert chat.format_chats(df.where("false"), "id", "record").count() == 0
    assert got[3]["layout"] == got[4]["layout"] != got[2]["layout"]


def test_decontamination_finds_what_brute_force_finds(spark, docs, empty):
    items = [(1, "What colour is the sky? Answer: it is blue on clear days and grey on others"), (2, BASE[5]), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leak = [(900, prose(200) + " " + items[0][1].upper() + " " + prose(150)), (901, prose(300)), (902, "What colour is the sky? Answer: nobody knows")]
    some = docs.select("doc_id", "text").union(spark.createDataFrame(leak, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(some, bench).collect()}
    assert got == {(900, 1), (DOCS[5][0], 2)}
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(docs, bench.where("false")).count() == 0
    kept = {r["doc_id"] for r in decontamination.without_leaks(some, bench).collect()}
    assert kept == {i for i, _ in [*DOCS, *leak]} - {900, DOCS[5][0]}


def test_block_bounds_lose_no_item():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(rng.randrange(8, 40)))) for i in range(150)]
    index = decontamination.ItemIndex.build(rows)
    text = " ".join(rows[k][1] + " " + prose(30) for k in (3, 77, 149)).encode()
    words, first = decontamination.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), decontamination.SEPARATES_MARKS)
    found = {(int(i), round(float(s), 9)) for _, i, s, _ in index.retrieve(words, first, 0.5)}
    want = set()
    for at in range(0, len(words), index.longest):
        scores = index.scores(index.terms_of(words[at : at + 2 * index.longest]))
        want |= {(int(i), round(float(scores[i]), 9)) for i in np.flatnonzero(scores >= 0.5)}
    assert found == want and {3, 77, 149} <= {i for i, _ in found}


def test_language(spark):
    rng = random.Random(4)
    sylls = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "er"], "cc": ["é", "eau", "oux", "an"]}
    said = lambda lang: " ".join("".join(rng.choice(sylls[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
    rows = [(i, said(lang), lang) for i in range(600) for lang in [("aa", "bb", "cc")[i % 3]]] + [(9001, None, "aa"), (9002, "123 ...", None), (9003, "", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language.languages(docs))
    held = [(i, lang) for i, _, lang in rows[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" for i in (9001, 9002, 9003)) and all(0 <= r["score"] <= 1 for r in got.values())
    none = language.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["grumbolt", "snarvik", "dweezle"]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(["the", "and", "house", "river", "stone", "light", "walks", "under", "little", "green"]) for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    rows += [(8000, None), (8001, ""), (8002, "the river g-r.umbolt under the stone"), (8003, "the little house snar xvik light")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(docs, marks))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    assert got[8000]["predicted"] == 0 and got[8000]["score"] == got[8001]["score"]
    assert got[8002]["score"] > 10 * got[8001]["score"]  # letters with others between still resemble the word
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, marks).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"] == 0}


def test_kernel_weights_equal_landmark_sums():
    """The table of weights gives what the kernel against each landmark gives; marks and single letters hide nothing."""
    a, b = toxicity.features("idiot"), toxicity.features("idxiot")
    direct = sum(v * b[k] for k, v in a.items())
    table = np.zeros(toxicity.SYMBOLS**4, np.float32)
    for k, v in a.items():
        table[k] = v
    model = toxicity.ToxicModel(table)
    worst = lambda *t: model.worst(*toxicity._joined(list(t)))
    assert worst("idxiot")[0, 0] == pytest.approx(direct, rel=1e-5)
    assert worst("i-d.i.o-t!")[0, 0] == worst("i d i o t")[0, 0] == worst("IDIOT")[0, 0] == pytest.approx(sum(v * v for v in a.values()), rel=1e-5)


def test_scores_depend_on_the_text_alone():
    """Toxicity and language of a text are the same alone and among others, at every border and length."""
    rng = random.Random(12)
    said = [*(t or "" for _, t in DOCS), "i", "id", "iot", "idiot", "é", "ß", " ", "", "xyz the", "the", "schön", "界" * 40]
    rows = [(prose(30) + (" grumbolt snarvik" if i % 3 == 0 else ""), i % 3 == 0) for i in range(90)]
    model = toxicity.fit([(t, int(x)) for t, x in rows])
    tongue = language.fit([(t, "a" if x else "b") for t, x in rows], [])
    alone = [model.worst(*toxicity._joined([t]))[0] for t in said]
    logits = [tongue.logits(*language._joined([t]))[0] for t in said]
    for _ in range(20):
        order = rng.sample(range(len(said)), len(said))
        batch = [said[i] for i in order]
        assert (model.worst(*toxicity._joined(batch)) == np.array([alone[i] for i in order])).all()
        assert (tongue.logits(*language._joined(batch), block=1 << 16) == np.array([logits[i] for i in order])).all()


def test_very_long_texts_are_read_in_runs():
    text = (prose(200) + " ") * 1500 + "grumbolt snarvik grumbolt"
    rows = [(prose(30) + (" grumbolt snarvik" if i % 3 == 0 else ""), i % 3 == 0) for i in range(90)]
    model = toxicity.fit([(t, int(x)) for t, x in rows])
    assert len(text) > 2 << 20
    long, short = (model.score(*toxicity._joined([t]))[0] for t in (text, text[:-26]))
    assert long >= 0.7 > short
    tongue = language.fit([(t, "a" if x else "b") for t, x in rows], [])
    data, offsets = language._joined(["ab", text, "cd"])
    assert np.allclose(tongue.logits(data, offsets, block=1000), tongue.logits(data, offsets, block=1 << 30), atol=1e-4)


def test_toxicity_of_empty_tables_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5.0, "x"), (2, None, 1.0, "y"), (2, None, 1.0, "y")], "doc_id long, text string, score double, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int, text string")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0} and toxicity.toxicity(docs.where("false"), none).count() == 0
    assert toxicity.without_toxic(docs, none).columns == docs.columns and language.languages(docs.where("false").withColumn("lang", F.lit("en"))).count() == 0
