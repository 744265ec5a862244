"""Sharding by vector bin packing, law `bytes`.

Groups are equal texts. A group's vector is (bytes, tokens, rows). Groups are hashed into CELLS cells, so the
driver packs a bounded number of vectors whatever the corpus: cells in falling order of their largest
coordinate go to the shard where the dot product with the residual capacity is highest. A group that alone
exceeds 1 / HOT of the corpus in any coordinate gets cells of its own by doc_id, as many as its share of CELLS: it
stays in one shard while it is below SPLIT_AT of a shard's capacity, and above that its cells are placed one by one.

Slots are gapless per shard without a window over a shard: a cell's first slot is the sum of the cells before
it, and rows are numbered inside a cell.

Cases: null text has size 1 and the checksum of no bytes; equal rows (even equal doc_id) each get a slot; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

CELLS, HOT, SPLIT_AT = 16384, 1024, 0.25


def pack(vectors: np.ndarray, items: list[list[int]], shards: int) -> np.ndarray:
    """Shard of each cell. vectors: cells x dimensions; items: the cells that are placed together."""
    total = vectors.sum(0)
    scale = np.where(total > 0, total / shards, 1.0)
    v = np.stack([vectors[i].sum(0) for i in items]) / scale if items else np.zeros((0, vectors.shape[1]))
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(v)), -v.max(1))) if len(v) else ():
        fit = residual @ v[i]
        s = int(np.argmax(fit))
        residual[s] -= v[i]
        out[items[i]] = s
    return out


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), word_count(F.col("text")).alias("tokens"), F.xxhash64("text").alias("g")))
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")]
    whole = rows.agg(*sums).first()
    if not whole["r"]:
        return rows.select("doc_id", "size", "text_crc32", "tokens", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = F.greatest(*[F.col(k) / max(1, whole[k]) for k in "btr"])
    heavy = rows.groupBy("g").agg(*sums).where(share * HOT > 1)  # at most 3 * HOT groups
    heavy = heavy.select("g", F.ceil(share * CELLS).cast("long").alias("hot"))
    cell = F.when(F.col("hot").isNotNull(), F.concat_ws("/", F.lit("h"), F.col("g"), F.pmod(F.xxhash64("doc_id"), F.col("hot")))).otherwise(F.concat_ws("/", F.lit("c"), F.pmod(F.col("g"), F.lit(CELLS))))
    rows = rows.join(F.broadcast(heavy), "g", "left").withColumn("cell", cell)
    cells = sorted(rows.groupBy("cell").agg(*sums).collect(), key=lambda x: x["cell"])  # at most 4 * CELLS + 3 * HOT rows
    v = np.array([[c[k] for k in "btr"] for c in cells], float)
    together: dict[str, list[int]] = {}
    for i, c in enumerate(cells):
        together.setdefault(c["cell"].rpartition("/")[0] if c["cell"][0] == "h" else c["cell"], []).append(i)
    capacity = np.maximum(1, v.sum(0)) / shards
    items = [m for ids in together.values() for m in ([ids] if (v[ids].sum(0) / capacity).max() <= SPLIT_AT else [[i] for i in ids])]
    placed = pack(v, items, shards)
    first, at = [], [0] * shards
    for c, s in zip(cells, placed.tolist()):
        first.append((c["cell"], s, at[s]))
        at[s] += c["r"]
    plan = spark.createDataFrame(first, "cell string, shard int, first long")
    w = Window.partitionBy("cell").orderBy("doc_id", "text_crc32")
    return rows.withColumn("n", F.row_number().over(w)).join(F.broadcast(plan), "cell").select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
