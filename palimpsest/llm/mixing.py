"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its weight's share of the mix, at most `cap` times its size; what is above is reshared by
weight (water filling, one aggregation per round). The mix is cut into equal-token blocks, which are the seats:
source i has floor(target / d + 1/2) of them, where the divisor d is found by bisection over aggregates, so
that the seats add up; ties go by quotient, then source. Seats are also apportioned to `shards` output shards:
the method is house monotone, so shard k gets the difference between the seats of two house sizes.

A source's documents stand in a seeded order and are cut into blocks of equal tokens. Every shard takes its quota of
every source in turn from a seeded order of the source's blocks, which starts over when all are taken, so a block is
taken at most `cap` times. Quotas are whole blocks; the last pick of a source is cut, or one more is begun, so that
its tokens are its target. A block is a few documents long at least (BLOCK_DOCS), so that few are cut.

A hot source is split: documents are summed in 4,096 hash spans per source, prefix sums run over the spans,
and rows are only numbered inside one (source, span) pair. What a document gives is the difference between two values of
a prefix sum over its source's blocks, looked up for its first and last token: documents aren't multiplied by blocks.

Cases: null and empty texts have size 0 and take nothing; a null source is a source of its own, last in order;
an empty table gives no rows; equal rows each count, rows of one doc_id are told apart by their text; columns other
than doc_id, text, source are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, cut, fresh, ordinals, per_batch, table, word_count

WEIGHTS, SHARE, CAP, SEATS, SHARDS, SEED = (3, 1, 2), 1.5, 2.0, 1000, 8, 20240229
#: Documents a block has on average, at least; rows of a lookup table that is sent to all executors, about 500 bytes each.
BLOCK_DOCS, LOOKUP = 8, 100_000


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS) -> DataFrame:
    """sources: src, source_size. Adds w, target double."""
    n = len(weights)
    ranked = ordinals(sources, [F.col("src.no"), F.col("src.name").cast("binary")], "rank")
    ranked = cut(ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(n)) + 1).cast("int"))))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, last = 0.0, -1
    top = F.col("source_size") * cap
    while True:
        below = F.col("w") * F.lit(level) < top
        used, free, capped = ranked.agg(F.coalesce(F.sum(F.when(~below, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(below, F.col("w"))), F.lit(0.0)), F.count(F.when(~below, 1))).first()
        if capped == last or not free:
            break
        last, level = capped, (total - used) / free
    return ranked.withColumn("target", F.least(F.col("w") * F.lit(level), top).cast("double"))


def seats(tg: DataFrame, houses: list[int]) -> DataFrame:
    """tg: src, target. Adds seats: array of the seats under each house size, by highest quotients t / (j - 1/2)."""
    total = tg.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    count = lambda d: F.floor(F.col("target") / F.lit(d) + 0.5)
    if total <= 0:
        return tg.withColumn("seats", F.array(*[F.lit(0).cast("long") for _ in houses]))
    bounds = [(0.0, 0.0) if h == 0 else (total / h / 4, total / h * 4) for h in houses]
    n = tg.count()
    bounds = [(lo, hi) if h == 0 else (total / (h + n + 1), max(hi, 2.0 * total + 1)) for (lo, hi), h in zip(bounds, houses)]
    for _ in range(9):  # 17 candidates a round narrow the divisor by 16 ** 9
        tries = [[lo + (hi - lo) * k / 16 for k in range(17)] if h else [1.0] for (lo, hi), h in zip(bounds, houses)]
        got = tg.agg(*[F.sum(count(d)).alias(f"s{i}_{k}") for i, ds in enumerate(tries) for k, d in enumerate(ds)]).first()
        new = []
        for i, (ds, h) in enumerate(zip(tries, houses)):
            if not h:
                new.append(bounds[i])
                continue
            over = [d for k, d in enumerate(ds) if got[f"s{i}_{k}"] >= h]
            under = [d for k, d in enumerate(ds) if got[f"s{i}_{k}"] <= h]
            new.append((max(over, default=ds[0]), min(under, default=ds[-1])))
        bounds = new
        if all(lo >= hi for lo, hi in bounds):
            break
    out = tg
    for i, ((lo, hi), h) in enumerate(zip(bounds, houses)):
        if not h:
            out = out.withColumn(f"_q{i}", F.lit(0).cast("long"))
            continue
        out = out.withColumn(f"_q{i}", count(hi).cast("long"))
        short = h - out.agg(F.sum(f"_q{i}")).first()[0]
        if short > 0:  # ties at the last quotient: the seats between the two divisors, by quotient, then source
            extra = out.where(count(lo) > F.col(f"_q{i}")).select("src", F.explode(F.sequence(F.col(f"_q{i}") + 1, count(lo).cast("long"))).alias("j"), "target")
            won = ordinals(extra.select("src", "j", (-F.col("target") / (F.col("j") - 0.5)).alias("q")), [F.col("q"), F.col("src.no"), F.col("src.name").cast("binary")], "at").where(F.col("at") < short)
            out = out.join(won.groupBy("src").agg(F.count("*").alias("more")), "src", "left").withColumn(f"_q{i}", F.col(f"_q{i}") + F.coalesce("more", F.lit(0))).drop("more")
    return out.withColumn("seats", F.array(*[f"_q{i}" for i in range(len(houses))])).drop(*[f"_q{i}" for i in range(len(houses))])


def picks(tg: DataFrame, block: float, cap: float, shards: int, seed: int) -> DataFrame:
    """The seeded block selection: src, shard, pick (from 0 in a source), no (of the block), words (all of the block, but
    for a source's last pick). tg: src, source_size, want (tokens), seats (array: after each shard)."""
    size = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.round(F.col("source_size") / F.lit(block))))).cast("long")
    b = tg.where("source_size > 0 and want > 0").withColumn("len", size).withColumn("blocks", F.ceil(F.col("source_size") / F.col("len")).cast("long"))
    each = b.withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("words", F.least("len", F.col("source_size") - F.col("no") * F.col("len")))
    laps = each.withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(int(math.ceil(cap)) - 1))))
    w = Window.partitionBy("src").orderBy("lap", F.xxhash64(F.lit(seed), "src", "no"), "no")  # at most cap * SEATS blocks a source
    run = laps.withColumn("pick", F.row_number().over(w) - 1).withColumn("before", F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).where("before < want")
    shard = F.least(F.size(F.filter("seats", lambda x: x <= F.col("pick"))), F.lit(shards - 1))
    return run.select("src", "len", shard.alias("shard"), "pick", "no", F.least("words", F.col("want") - F.col("before")).cast("long").alias("words"), F.col("words").alias("full"))


def plan_mix(docs: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple = WEIGHTS, seats_per_source: int = SEATS, shards: int = SHARDS, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, picks). documents: doc_id, row (hash of the text), size, source_size, target, taken,
    shard_words (array: what each shard takes), src, at (the document's place in its source), len (tokens of a block),
    whole (laps that take it whole, null where a block ends inside it); sources: src, source_size, target, seats
    (array: after each shard); picks as those of picks()."""
    src = F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).cast("string").alias("name"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), src.alias("src"), word_count(F.col("text")).alias("size"), order.alias("o")).withColumn("span", F.shiftrightunsigned("o", 52).cast("int")))
    spans = cut(rows.groupBy("src", "span").agg(F.sum("size").alias("tokens"), F.count("*").alias("rows")))
    sources = cut(spans.groupBy("src").agg(F.sum("tokens").alias("source_size"), F.sum("rows").alias("rows")))
    tg = cut(targets(sources, share, cap, weights))
    total, n, n_rows = tg.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    house = int(max(1, min(max(1, n) * seats_per_source, max(n, n_rows // block_docs), total)))
    block = max(1.0, total / house)
    plan = seats(tg, [house * (k + 1) // shards for k in range(shards)])
    plan = cut(plan.select("src", "source_size", "target", F.lit(block).alias("block"), "seats", F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(cap))).cast("long").alias("want")))
    chosen = cut(picks(plan, block, cap, shards, seed))
    # the prefix sums, by shard, at the start of every block, and what is taken inside it
    by = chosen.groupBy("src", "no").agg(F.first("len").alias("len"), F.first("full").alias("full"), *[F.coalesce(F.sum(F.when((F.col("shard") == s) & (F.col("words") == F.col("full")), 1)), F.lit(0)).alias(f"w{s}") for s in range(shards)], *[F.coalesce(F.sum(F.when((F.col("shard") == s) & (F.col("words") < F.col("full")), F.col("words"))), F.lit(0)).alias(f"c{s}") for s in range(shards)])
    grid = chosen.groupBy("src").agg(F.first("len").alias("len")).join(plan.select("src", "source_size"), "src").withColumn("no", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("source_size") / F.col("len")).cast("long"))))
    grid = grid.join(by.drop("len", "full"), ["src", "no"], "left")
    room = F.least(F.col("len"), F.col("source_size") - F.col("no") * F.col("len"))
    w = Window.partitionBy("src").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)  # at most SEATS blocks a source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    grid = grid.select("src", "no", "len", *[F.struct(F.coalesce(F.sum(zero(f"w{s}") * room + zero(f"c{s}")).over(w), F.lit(0).cast("long")).alias("base"), zero(f"w{s}").alias("whole"), zero(f"c{s}").alias("cut")).alias(f"s{s}") for s in range(shards)])
    grid = cut(grid.select("src", "no", F.array(*[f"s{s}" for s in range(shards)]).alias("facts")))
    w = Window.partitionBy("src").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a source
    placed = spans.withColumn("base", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(plan.select("src", "source_size", "target"), "src").join(chosen.groupBy("src").agg(F.first("len").alias("len")), "src", "left").select("src", "span", "base", "source_size", "target", "len")
    inner = Window.partitionBy("src", "span").orderBy("o", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(placed, ["src", "span"]).withColumn("at", F.col("base") + F.col("before"))
    if grid.count() <= LOOKUP:  # else shuffled: a block has a bounded share of a source
        grid = F.broadcast(grid)
    look = lambda name: grid.select(F.col("src").alias(f"src_{name}"), F.col("no").alias(f"no_{name}"), F.col("facts").alias(name))
    end = F.col("at") + F.col("size")
    at = at.withColumn("no_a", F.expr("at div len")).withColumn("no_b", F.expr("(at + size) div len")).withColumn("end", end)
    for name in ("lo", "hi"):
        own = "no_a" if name == "lo" else "no_b"
        at = at.join(look(name), (F.col("src") == F.col(f"src_{name}")) & (F.col(own) == F.col(f"no_{name}")), "left").drop(f"src_{name}", f"no_{name}")
    value = lambda f, x: f["base"] + f["whole"] * x + F.least(f["cut"], x)
    words = F.when((F.col("size") == 0) | F.col("lo").isNull() | F.col("hi").isNull(), F.array_repeat(F.lit(0).cast("long"), shards)).otherwise(
        F.zip_with("lo", "hi", lambda a, b: (value(b, F.col("end") - F.col("no_b") * F.col("len")) - value(a, F.col("at") - F.col("no_a") * F.col("len"))).cast("long"))
    )
    at = at.withColumn("shard_words", words).withColumn("taken", F.aggregate("shard_words", F.lit(0).cast("long"), lambda a, x: a + x))
    inside = (F.expr("at div len = (end - 1) div len")) & (F.aggregate("lo", F.lit(0).cast("long"), lambda a, f: a + f["cut"]) == 0)
    whole = F.when(F.col("taken") == 0, 0).when(inside, F.expr("cast(taken div size as int)"))
    documents = at.withColumn("whole", whole).select("doc_id", "row", "size", "source_size", "target", "taken", "shard_words", "src", "at", "len", "whole")
    return documents, plan, chosen


def stretches(taken: list) -> list[tuple[int, int]]:
    """The words [a, b) of a document that are taken, lap by lap, adjoining ones joined. taken: (lap, a, b)."""
    out: list[list[int]] = []
    last = None
    for lap, a, b in sorted(map(tuple, taken)):
        if last == lap and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
        last = lap
    return [(a, b) for a, b in out]


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix as documents, with their own columns: one row for each lap that takes a document, or for each stretch of
    its words where blocks end inside it; n_chars then follows the text. Equal rows are taken each for itself."""
    documents, _, chosen = plan_mix(docs, **kw)
    documents = cut(documents.where("taken > 0").drop("shard_words", "target", "source_size", "taken"))
    part = documents.where("whole is null").withColumn("no", F.explode(F.expr("sequence(at div len, (at + size - 1) div len)")))
    # a pick of a block is one lap of it
    lap = Window.partitionBy("src", "no").orderBy("pick")  # at most cap picks a block
    runs = chosen.withColumn("lap", F.row_number().over(lap)).select("src", "no", "lap", "words")
    if runs.count() <= LOOKUP:
        runs = F.broadcast(runs)
    got = part.join(runs, ["src", "no"]).withColumn("a", F.greatest(F.lit(0).cast("long"), F.col("no") * F.col("len") - F.col("at"))).withColumn("b", F.least(F.col("size"), F.col("no") * F.col("len") + F.col("words") - F.col("at"))).where("a < b")
    got = got.groupBy("doc_id", "row", "at", "size").agg(F.collect_list(F.struct("lap", "a", "b")).alias("parts"))  # one document's own
    plan = documents.where("whole > 0").select("doc_id", "row", "at", "size", F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole").cast("long")), lambda k: F.struct(k.cast("int").alias("lap"), F.lit(0).cast("long").alias("a"), F.col("size").alias("b"))).alias("parts")).unionByName(got)
    w = Window.partitionBy("doc_id", "row").orderBy("at")
    plan = cut(plan.withColumn("k", F.row_number().over(w)))
    key, row, k, facts = fresh(docs, "_id", "_row", "_k", "_m")
    plan = plan.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("k").alias(k), F.struct("size", "parts").alias(facts))
    text_row = F.xxhash64("text")
    names = docs.columns
    cols = [F.col(f"`{c}`") for c in names]
    on = (F.col("doc_id") == F.col(key)) & (text_row == F.col(row))
    again = plan.where(F.col(k) > 1).select(key, row).distinct()
    if again.isEmpty():
        j = docs.join(plan, on).select(*cols, facts)
    else:  # equal rows are numbered, so that each takes what is its own
        number = F.row_number().over(Window.partitionBy("doc_id", text_row).orderBy("doc_id"))
        (mine,) = fresh(docs, "_mine")
        more = docs.join(again, on, "left_semi").withColumn(mine, number).join(plan, on & (F.col(mine) == F.col(k)))
        j = docs.join(again, on, "left_anti").join(plan.join(again, [key, row], "left_anti"), on).select(*cols, facts).unionByName(more.select(*cols, facts))
    at, chars = names.index("text"), next((i for i, c in enumerate(names) if c == "n_chars"), None)

    def render(b: pa.RecordBatch):
        take, texts, lengths = [], [], []
        for i, (t, m) in enumerate(zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())):
            spans = None
            for x, y in stretches([(p["lap"], p["a"], p["b"]) for p in m["parts"]]):
                take.append(i)
                if (x, y) == (0, m["size"]):
                    texts.append(t)
                else:
                    spans = spans or [w.span() for w in WORD_RE.finditer(t)]
                    texts.append(t[spans[x][0] : spans[y - 1][1]])
                lengths.append(len(texts[-1]))
        out = b.take(pa.array(take, pa.int64()))
        arrays = [out.column(i) for i in range(len(names))]
        arrays[at] = pa.array(texts, arrays[at].type)
        if chars is not None:
            arrays[chars] = pa.array(lengths, arrays[chars].type)
        yield pa.RecordBatch.from_arrays(arrays, names)

    return per_batch(j, render, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "shard_words")
