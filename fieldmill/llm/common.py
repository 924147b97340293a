"""Pieces that several text operators share: staged tables, gapless numbers, connected groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a session on one machine
    gets a temporary one; on a cluster that is an error, as executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            folder = set_dir.get()
        elif spark.sparkContext._jsc.sc().isLocal():
            folder = f"file://{tempfile.mkdtemp(prefix='staged-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a step's shuffle files go when it ends, not when the driver next collects garbage: they would pile up on the disks."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, rows: int, per_part: int = 200_000) -> DataFrame:
    """Gapless numbers from 0 within each group, without bringing a group's rows into one task.

    Each group is cut into hash parts of about per_part rows at most; parts are counted, their
    counts summed up in order, and rows numbered inside their part. `rows` is the table's row count.
    """
    parts = 1
    while parts * per_part < rows:
        parts *= 2
    part = F.pmod(F.xxhash64(*order, F.lit("part")), F.lit(parts)).cast("int")
    cut = df.withColumn("_part", part)
    counts = cut.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_part"]))
    joined = ranked.alias("r").join(starts.alias("s"), same)
    keep = [F.col(f"r.{c}") for c in df.columns]
    return joined.select(*keep, (F.col("r._rank") + F.col("s._start")).cast("long").alias(name))


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node reachable.

    Edges (a, b) may repeat and run either way. Large-star and small-star rounds in turn, each
    staged, until every edge leads to a node with no smaller neighbour; a round costs two aggregations of the edges,
    and hubs spread over tasks because no step needs a node's neighbours in one place other than as a minimum.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        linked = both.join(least, both.a == least.n)
        if large:
            out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return tidy(out)

    def settled(e: DataFrame) -> bool:
        """Whether each larger end has one smaller neighbour, and that one none."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        each = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
        return not each.agg(F.max((F.col("ups") > 1) | ((F.col("ups") > 0) & (F.col("down") > 0)))).first()[0]

    now = staged(tidy(edges).distinct(), "edges")
    for _ in range(rounds):
        if settled(now):
            break
        # the first star leaves no more edges than there are: they are told apart once, after the second
        later = staged(star(star(now, True), False).distinct(), "edges")
        drop_staged(now)
        now = later
    else:
        raise RuntimeError("groups did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
