"""Quality rules whose cutoffs come with a guarantee on good documents.

For each stratum and rule, a fixed ladder of cutoffs is walked from lenient to strict. A cutoff is
certified if, were it to reject a share `risk` / rules of the stratum's good documents or more, seeing as few
rejections among the labelled good ones as were seen would have an exact binomial probability of at
most `error` / (strata * rules). The walk stops at the first cutoff that isn't certified (fixed-sequence
testing), so with probability 1 - error all rules together reject at most `risk` of the good documents of any stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose measure lies over the cutoff; cutoffs run from lenient to strict."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


def _ladder(high: float, low: float, steps: int) -> tuple[float, ...]:
    return tuple(round(high - (high - low) * i / (steps - 1), 6) for i in range(steps))


RULES = (
    Rule("symbols", "n_symbols / n_words", _ladder(1.0, 0.02, 50)),
    Rule("repeated_lines", "n_dup_lines / (n_dup_lines + 5)", _ladder(0.9, 0.1, 33)),
    Rule("repeated_words", "n_repeat_words / n_words", _ladder(0.5, 0.02, 49)),
    Rule("long_words", "word_chars / n_words", _ladder(30.0, 5.0, 101)),
)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Word, symbol, line and repetition counts of whole texts, within each row and without a shuffle.

    A null text counts nothing anywhere. Columns named in `keep` are carried along.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    base = base.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    base = base.withColumn("_n", F.size("_words"))
    # three-word windows, hashed from the word list against itself moved on by one and two
    ahead = lambda k: F.slice("_words", k + 1, F.greatest(F.col("_n") - 2, F.lit(0)))
    hashed = F.when(F.col("_n") >= 3, F.transform(F.arrays_zip(ahead(0).alias("a"), ahead(1).alias("b"), ahead(2).alias("c")), lambda w: F.xxhash64(w["a"], w["b"], w["c"])))
    base = base.withColumn("_windows", hashed)
    base = base.withColumn("_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    ordered = F.when(F.col("_twice"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("_ordered", ordered)
    # a window found again stands beside its like; the neighbours are the same list moved by one
    n = F.size("_ordered")
    none = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("i")))
    before = F.concat(none, F.slice("_ordered", 1, n - 1))
    after = F.concat(F.slice("_ordered", 2, n - 1), none)
    marked = F.transform(F.arrays_zip(F.col("_ordered").alias("x"), before.alias("p"), after.alias("q")), lambda w: F.when((w["x"]["h"] == w["p"]["h"]) | (w["x"]["h"] == w["q"]["h"]), w["x"]["i"]).otherwise(F.lit(-1)))
    base = base.withColumn("_found", F.when(F.col("_twice"), F.array_remove(marked, -1)))
    covered = F.array_distinct(F.concat("_found", F.transform("_found", lambda i: i + 1), F.transform("_found", lambda i: i + 2)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    base = base.withColumn("_lines", lines)
    return base.select(
        "doc_id",
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twice"), F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(hits: Column, trials: Column, risk: float) -> Column:
    """P(Binomial(trials, risk) <= hits), summed exactly term by term from logarithms."""
    odds = F.lit(risk / (1 - risk))
    first = trials * F.log(F.lit(1 - risk))
    start = F.struct(first.alias("term"), F.exp(first).alias("sum"))
    terms = F.when(hits > 0, F.sequence(F.lit(1).cast("long"), hits)).otherwise(F.array().cast("array<bigint>"))
    step = lambda s, i: F.struct((s["term"] + F.log((trials - i + 1) / i * odds)).alias("term"), (s["sum"] + F.exp(s["term"] + F.log((trials - i + 1) / i * odds))).alias("sum"))
    return F.when(hits >= trials, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(terms, start, step, lambda s: s["sum"])))


def certified_cutoffs(labelled: DataFrame, stratum: str, good: Column, rules: tuple[Rule, ...] = RULES, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, rule, cutoff, trials, hits, tail): the strictest certified cutoff of each stratum and rule.

    `labelled` has the measures of held-out documents, one row each; rows that fail the base rules don't count.
    """
    held = labelled.where(good & ~base_failed())
    counts = [F.count_if(F.expr(r.measure) > c).alias(f"{j}_{i}") for j, r in enumerate(rules) for i, c in enumerate(r.cutoffs)]
    per = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("trials"), *counts)
    rungs = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("rung"), F.lit(c).alias("cutoff"), F.col(f"{j}_{i}").alias("hits")) for j, r in enumerate(rules) for i, c in enumerate(r.cutoffs)))
    number = per.agg(F.count("*").alias("strata"))  # one row
    rows = per.select("stratum", "trials", F.explode(rungs).alias("r")).select("stratum", "trials", "r.*").crossJoin(F.broadcast(number))
    tested = rows.withColumn("tail", binomial_tail(F.col("hits"), F.col("trials"), risk / len(rules)))
    passed = F.col("tail") <= error / (F.col("strata") * len(rules))
    walk = Window.partitionBy("stratum", "rule").orderBy("rung").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = tested.withColumn("_ok", F.min(passed.cast("int")).over(walk)).where("_ok = 1")
    best = kept.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "trials", "hits", "tail"), "rung").alias("x"))
    return best.select("stratum", "rule", "x.*")


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES, risk: float = 0.05, error: float = 0.05, most_strata: int = 2000) -> DataFrame:
    """Every document's counts, whether it fails the base rules, and whether it is kept.

    labels: doc_id, quality (1 is good). A stratum or rule without a certified cutoff rejects nothing.
    Documents with a null stratum form one of their own. A null text has no words and fails the base
    rules. Texts are counted whole, however long; an empty table gives no rows; other columns are ignored. Repeated ids are judged row by row; where labels repeat an id, the lowest label counts.
    Cutoffs are broadcast when the strata number most_strata or fewer, else joined by a shuffle.
    """
    clean = docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    counted = staged(measured(clean, keep=("stratum",)), "measures")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_quality")).where("_quality is not null")
    cutoffs = certified_cutoffs(counted.join(marks, "doc_id"), "stratum", F.col("_quality") == 1, rules, risk, error)
    table = staged(cutoffs.groupBy("stratum").pivot("rule", [r.name for r in rules]).agg(F.first("cutoff")), "cutoffs")
    small = table.count() <= most_strata
    joined = counted.join(F.broadcast(table) if small else table, "stratum", "left")
    over = F.lit(False)
    for rule in rules:
        over = over | F.coalesce(F.expr(rule.measure) > F.col(rule.name), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))
