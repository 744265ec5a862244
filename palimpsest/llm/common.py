"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever the operators count words.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Rows with a key heavier than total / HEAVY_SHARE are "hot"; so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 2000
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Where it is unset a local session, as in
    tests, gets a folder of its own; on a cluster that is an error, as executors can't see the driver's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder and not sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-", dir=os.environ.get("TMPDIR"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and returns the stored rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds that nothing refers to them any more; this has it look now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches to Python end at 4 MB instead of at 10,000 rows, unless the session says less."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= 2048:
        spark.conf.set(rows, "2048")
    spark.conf.set(size, "4194304")


def per_batch(df: DataFrame, fn, schema) -> DataFrame:
    """fn: Arrow batch -> iterable of Arrow batches; a worker holds SLICE rows at a time in Python."""

    small_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                yield from fn(b.slice(at, SLICE))

    return df.mapInArrow(run, schema)


def sample(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """At most n rows, those with the smallest seeded hashes. A threshold on the hash, from the number of rows, goes
    first, so that no partition sends n rows anywhere."""
    total = df.count()
    h = F.xxhash64(F.lit(seed), F.col(ident))
    if total > 2 * n:
        df = df.where(h < int(-(2**63) + 2**64 * min(1.0, 1.25 * n / total)))
    return df.orderBy(h, ident).limit(n)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null; JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, ident: Column) -> DataFrame:
    """Left join of rows with one fact row per key, safe where one key has a third of all rows.

    facts carries the number of rows of its key in `weight`. Keys above total / HEAVY_SHARE (so at most
    HEAVY_SHARE of them, whatever the size) are broadcast; rows of such keys get a salted join key of
    their own, so that the shuffle join spreads them.
    """
    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    limit = max(1000, total // HEAVY_SHARE)
    cols = [c for c in facts.columns if c not in keys]
    hot = facts.where(F.col(weight) > limit).select(*keys, F.struct(*cols).alias("_hot"))
    cold = facts.where(F.col(weight) <= limit).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(0).cast("long").alias("_salt0"), F.struct(*cols).alias("_cold"))
    j = rows.join(F.broadcast(hot), keys, "left")
    j = j.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.xxhash64(ident).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long"))
    on = F.col("_salt") == F.col("_salt0")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    j = j.join(cold, on, "left")
    both = F.coalesce("_hot", "_cold")
    return j.select(*rows.columns, *[both[c].alias(c) for c in cols])


def running(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds the sum of the weights before each row in a global order, without a single-task window: a range partitioning,
    then one offset per partition."""
    spark = df.sparkSession
    parts = cut(df.withColumn("_w", weight.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    from pyspark.sql import Window

    sums = sorted((r["_p"], r["s"]) for r in parts.groupBy("_p").agg(F.sum("_w").alias("s")).collect())  # a row per partition
    offsets, at = [], 0
    for p, n in sums:
        offsets.append((p, at))
        at += n
    offs = spark.createDataFrame(offsets or [(0, 0)], "_p int, _off long")
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_n", F.coalesce(F.sum("_w").over(w), F.lit(0)))
    return before.join(F.broadcast(offs), "_p").withColumn(name, (F.col("_off") + F.col("_n")).cast("long")).drop("_p", "_n", "_off", "_w")


def ordinals(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 in a global order."""
    return running(df, order, F.lit(1), name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: u, v long. Returns one row per vertex with an edge: v, root (its component's smallest vertex).
    Every step is a grouped aggregation and a join; the lineage is cut at each round.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        b = both(e)
        low = b.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour links to the smallest of the neighbourhood
        large = b.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the vertex itself, links to the smallest
        g = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(g, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(g.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last:
            break
        last = sign
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("v"), F.col("v").alias("root")).distinct())
