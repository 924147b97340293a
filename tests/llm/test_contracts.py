"""Registered queries on small tables with nulls, repeats, long texts and odd columns, against brute force over the same rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldmill.llm import chat, decontamination, queries, suffixes
from pyspark.sql import functions as F

RNG = random.Random(23)


def prose(n):
    return " ".join(RNG.choice("alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()) + str(RNG.randrange(60)) for _ in range(n))


LONG = prose(30_000)
SHARED = prose(40)
TEXTS = [prose(50), None, "", "one two", LONG, prose(20) + " " + SHARED, SHARED + " " + prose(20), "é" * 90, "é" * 90, " \t\n", "x " * 400, "###\n" + prose(9)]
TEXTS += [TEXTS[0], TEXTS[0].replace("alpha", "ALPHA", 2), TEXTS[0] + " more", LONG + " tail", "ONE  two"]
DOCS = [(7 * i + 2, t) for i, t in enumerate(TEXTS)]
TALKS = [(1, 1, "user", "a"), (1, 2, "assistant", "b </s> <|turn|> &lt;"), (1, 0, "system", ""), (2, 0, None, None), (2, 1, "assistant", LONG), (3, 0, "user", "<|over|>"), (3, 1, "assistant", ""), (3, 2, "assistant", "é\n\U0001f600"), (4, 0, "user", "x"), (4, 0, "user", "x")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = [(i, t, None, "s", len(t or ""), 1, "z", 2) for i, t in DOCS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, _own int").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(*t, "z") for t in TALKS], "conv_id long, turn long, role string, text string, turns string").repartition(3).write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.fixture(scope="module")
def none(spark, sf, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('none')}"
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{root}/{t}.parquet")
    return root


def test_op1(spark, sf, none):
    rows = queries.op1_sharding(spark, sf).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in DOCS)
    shards = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < 40 and r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    again = {r["doc_id"]: r["shard"] for r in queries.op1_sharding(spark, sf).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows} and queries.op1_sharding(spark, none).count() == 0


def test_op2(spark, sf, none):
    got = {r["doc_id"]: r for r in queries.op2_suffix_array_dedup(spark, sf).collect()}
    seen = set()
    for i, t in DOCS:
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b), bool)
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(own)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if b else 0
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert queries.op2_suffix_array_dedup(spark, none).count() == 0


def test_op2_judges_rows_of_one_id_by_their_own_text(spark):
    a, b, c, d = (prose(20) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (-3, d), (5, d), (5, d), (None, d + " " + prose(5))]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    removed = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got)
    n = lambda t: len(t.encode())
    tail = rows[-1][1]
    want = [(1, a, 0), (5, a, n(a)), (5, b, 0), (None, a, n(a)), (None, c, 0), (-3, d, 0), (5, d, n(d)), (5, d, n(d)), (None, tail, n(d))]
    assert removed == sorted((i is None, i or 0, n(t), g) for i, t, g in want)


def test_op6(spark, sf, none):
    sets = {}
    for i, t in DOCS:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_ngram_jaccard_join(spark, sf).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert queries.op6_ngram_jaccard_join(spark, none).count() == 0


def test_op7(spark, sf, none):
    talks = defaultdict(list)
    for c, turn, role, text in [*TALKS, *queries.PROBE]:
        talks[c].append((turn, role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, turns in talks.items():
        turns.sort()
        learned = "".join(t for _, role, t in turns if role == "assistant")
        want[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), digest(learned))
    got = {r["conv_id"]: r for r in queries.op7_chat_formatting(spark, sf).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    assert [r["conv_id"] for r in queries.op7_chat_formatting(spark, none).collect()] == [-1]


def test_texts_over_the_json_readers_limit(spark):
    """A struct's text is formatted however long it is; a JSON record that the reader can't take says so."""
    big = spark.range(1).select(F.col("id"), F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.expr("repeat('long<text&', 2500000)").alias("content"))).alias("messages"))
    done = chat.format_chats(big.select("id", F.struct("messages").alias("r")), "id", "r")
    back = chat.read_back(F.col("formatted"))
    r = done.select(F.size(back), F.length(back[1]["text"]), back[1]["text"] == F.expr("repeat('long<text&', 2500000)"), F.length(chat.under_mask(F.col("formatted"), F.col("loss_spans"))[0]), "problem").first()
    assert tuple(r) == (2, 25_000_000, True, 25_000_000, None)
    r = chat.format_chats(big.select("id", F.to_json(F.struct("messages")).alias("r")), "id", "r").select("problem", "turns", "formatted").first()
    assert r["turns"] is not None or r["problem"] == "over the JSON reader's limit"


def test_structs_take_the_same_mappings(spark):
    rows = spark.range(2).select("id", F.when(F.col("id") == 0, F.struct(F.lit("do").alias("instruction"), F.lit("").alias("input"), F.lit("done").alias("output"))).alias("r"))
    got = {r["conv_id"]: r for r in chat.format_chats(rows, "id", "r").collect()}
    assert [tuple(t) for t in got[0]["turns"]] == [("user", "do"), ("assistant", "done")] and got[0]["problem"] is None
    assert got[1]["turns"] is None and got[1]["problem"] == "null record"
    json = chat.format_chats(rows.select("id", F.to_json("r").alias("r")), "id", "r").where("conv_id = 0").first()
    assert (json["layout"], json["formatted"]) == (got[0]["layout"], got[0]["formatted"])
    odd = spark.range(1).select("id", F.struct(F.lit(1).alias("odd")).alias("r"))
    assert chat.format_chats(odd, "id", "r").first()["problem"] == "unknown layout"


def test_short_answers_with_a_changed_word(spark):
    question = "Which plan did the council discuss in its long meeting on the second of March in the old town hall?"
    bench = spark.createDataFrame([(1, f"{question} It approved the revised plan.")], "item_id long, text string")
    docs = [(1, f"{prose(90)} {question} It approved the amended plan. {prose(60)}", 9), (2, f"{prose(90)} {question} Nobody can say. {prose(60)}", 9), (3, f"{prose(50)} It approved the revised plan. {prose(50)}", 9), (4, None, 9), (1, prose(40), 9)]
    table = spark.createDataFrame(docs, "doc_id long, text string, score int")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(table, bench).collect()} == {(1, 1)}
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(table, bench).collect()) == [1, 2, 3, 4]
