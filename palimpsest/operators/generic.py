"""Relational operators on any DataFrame: as-of and interval joins, suppressed reports, statistics, grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parts(df: DataFrame, size: int = 4 << 20) -> int:
    """A number of partitions that follows the input, so that what a task sorts doesn't: as many as the session shuffles to, or
    one for each 4 MB that the plan expects. Stated numbers aren't coalesced."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-expected // size))


def suppressed_topk(df: DataFrame, value: str, k: int = 32, least: int = 5) -> DataFrame:
    """Groups of at least `least` rows, the k largest (ties by value), each with what is not published: rows left
    out and the number of all groups. Groups are summed before anything is ranked."""
    groups = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    top = groups.where(F.col("n") >= least).orderBy(F.desc("n"), F.asc("value")).limit(k)  # the report's own limit
    shown = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"))
    return top.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(shown)).select("value", "n", (F.col("rows") - F.col("shown")).alias("suppressed_rows"), "groups")  # one-row sides


def distribution(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, low, median, high. Values are counted before they are ordered, so a task holds distinct values only in part: ranges of
    values get their offset from one sum a range, and the middle rows are looked up by number."""
    c = df.groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    if by:
        counted = c.withColumn("_upto", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    else:  # no single-task window over a whole corpus
        ranged = c.repartitionByRange("v").withColumn("_p", F.spark_partition_id())
        sums = ranged.groupBy("_p").agg(F.sum("n").alias("_s"))
        offs = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_s").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # a row a partition
        inner = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        counted = ranged.withColumn("_in", F.sum("n").over(inner)).join(F.broadcast(offs), "_p").withColumn("_upto", F.col("_in") + F.col("_before"))
    lo, hi = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    at = lambda k: F.max(F.when((F.col("_upto") >= k) & (F.col("_upto") - F.col("n") < k), F.col("v")))
    g = counted.groupBy(*by) if by else counted
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("v").alias("low"), ((at(lo) + at(hi)) / 2.0).alias("median"), F.max("v").alias("high"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation per group; null below two rows or without variance."""
    ok = (F.count("*") >= 2) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.when(ok, F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))).alias("r"), F.count("*").alias("n"))


def bit_frequency(df: DataFrame, flags: str, bits: int = 31, least: int = 5) -> DataFrame:
    """Rows that have each bit, one pass with one sum per bit; bits below `least` are left out."""
    sums = [F.sum(F.shiftright(F.col(flags).cast("long"), b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(bits)]
    return df.agg(F.array(*sums).alias("s")).select(F.posexplode("s").alias("bit", "n")).where(F.col("n") >= least)


def mode_multiples(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mode (smallest of ties) and how many rows are exact multiples of it."""
    g = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    mode = g.groupBy(*by).agg(F.max_by(value, F.struct("c", -F.col(value))).alias("mode"))
    return g.join(mode, by).groupBy(*by, "mode").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col(value) % F.col("mode") == 0, F.col("c"))), F.lit(0)).alias("multiples"))


def tolerance_bands(df: DataFrame, delta: Column, widths: range) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.abs(delta) <= k).alias(f"within_{k}") for k in widths])


def asof(events: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, strict: bool = False, forward: bool = False) -> DataFrame:
    """Each event with the nearest mark at or before it (or after it): union and one window, so one shuffle on
    `by`; no event meets more than its own group's marks."""
    e = events.withColumn("_t", F.col(at)).withColumn("_m", F.lit(None).cast(marks.schema[mark].dataType)).withColumn("_side", F.lit(1))
    m = marks.select(*by, F.col(mark).alias("_t"), F.col(mark).alias("_m")).withColumn("_side", F.lit(2 if strict != forward else 0))
    both = e.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side")
    pick = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("matched", pick).where("_side = 1").select(*events.columns, "matched")


def merge_intervals(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Union of touching or overlapping intervals per group."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    isles = df.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0)).withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy(*by, "_isle").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_isle")


def gaps(df: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """What lies between the merged intervals of a group."""
    w = Window.partitionBy(*by).orderBy(lo)
    return merge_intervals(df, by, lo, hi).withColumn("gap_start", F.lag(hi).over(w)).withColumn("gap_end", F.col(lo)).where("gap_start is not null").select(*by, "gap_start", "gap_end")


def contained(items: DataFrame, ranges: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Items inside one merged range of their group. Merged ranges are disjoint, so the only candidate is the last
    range that starts at or before the item: an as-of lookup and no band join."""
    r = merge_intervals(ranges, by, lo, hi)
    e = items.withColumn("_t", F.col(lo)).withColumn("_r", F.lit(None).cast(r.schema[hi].dataType)).withColumn("_side", F.lit(1))
    m = r.select(*by, F.col(lo).alias("_t"), F.col(hi).alias("_r")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(m, allowMissingColumns=True).withColumn("_end", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select(*items.columns, F.coalesce(F.col("_end") >= F.col(hi), F.lit(False)).alias("inside"))


def dense_grid(tables: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Every coordinate of each declared grid, with its cell or none."""
    grid = tables.select(key, "rows", "cols").select(key, "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select(key, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return grid.join(cells, [key, "row", "col"], "left")


def apportion(df: DataFrame, by: list[str], weight: str, idx: str, total: int) -> DataFrame:
    """Largest remainders: whole shares that add up to total in each group."""
    w = Window.partitionBy(*by)
    s = F.sum(weight).over(w)
    exact = df.withColumn("_s", s).withColumn("share", F.expr(f"({weight} * {total}L) div _s")).withColumn("_r", F.col(weight) * F.lit(total).cast("long") % F.col("_s"))
    left = F.lit(total) - F.sum("share").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("_r"), idx))
    return exact.withColumn("_left", left).withColumn("_rank", rank).withColumn("share", F.col("share") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).drop("_s", "_r", "_left", "_rank")


def positional_compare(expected: DataFrame, actual: DataFrame, key: str, items: str) -> DataFrame:
    """Two arrays per key, item by item to the shorter one, and a row where their lengths differ."""
    j = expected.select(key, F.col(items).alias("e")).join(actual.select(key, F.col(items).alias("a")), key)
    n = F.least(F.size("e"), F.size("a"))
    pairs = j.select(key, F.posexplode(F.zip_with(F.slice("e", 1, n), F.slice("a", 1, n), lambda x, y: F.struct(x.alias("e"), y.alias("a")))).alias("pos", "p")).where("not (p.e <=> p.a)").select(key, F.lit("item-differs").alias("issue"), F.col("pos").cast("long").alias("pos"))
    return pairs.unionByName(j.where(F.size("e") != F.size("a")).select(key, F.lit("count-mismatch").alias("issue"), n.cast("long").alias("pos")))


def kanon_groups(df: DataFrame, unit: str, cls: str, k: int = 5) -> DataFrame:
    """Classes seen in at least k units: units, occurrences, share of all units in per cent; the rest are one row of
    sums."""
    g = df.groupBy(cls).agg(F.countDistinct(unit).alias("units"), F.count("*").alias("occurrences"))
    total = df.agg(F.countDistinct(unit).alias("total"))
    shown = g.where(F.col("units") >= k).crossJoin(F.broadcast(total)).select(F.col(cls).alias("class"), "units", "occurrences", F.bround(100.0 * F.col("units") / F.col("total"), 1).alias("percent"))
    rest = g.where(F.col("units") < k).agg(F.lit("(suppressed)").alias("class"), F.count("*").alias("units"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.lit(None).cast("double").alias("percent"))
    return shown.unionByName(rest)


def greedy_budget(df: DataFrame, by: list[str], order: str, size: str, cap: int) -> DataFrame:
    """Which rows of a group fit a budget if each that doesn't is skipped and the rest go on. Groups are one document's
    blocks: their sizes go through one linear pass, many groups an Arrow batch."""
    @F.pandas_udf("array<boolean>")
    def fits(sizes: pd.Series) -> pd.Series:
        def one(xs):
            used, out = 0, []
            for x in xs:
                ok = used + x <= cap
                used += x if ok else 0
                out.append(ok)
            return out

        return sizes.map(one)

    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("a"))
    kept = rows.select(*by, F.transform("a", lambda x: x["o"]).alias("o"), fits(F.transform("a", lambda x: x["s"])).alias("kept"))
    return kept.select(*by, F.explode(F.arrays_zip("o", "kept")).alias("x")).select(*by, F.col("x.o").alias(order), F.col("x.kept").alias("kept"))


def asof_both(events: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str) -> DataFrame:
    """Each event with the last mark at or before it and the first one at or after it: one union, one shuffle."""
    kind = marks.schema[mark].dataType
    e = events.withColumn("_t", F.col(at)).withColumn("_m", F.lit(None).cast(kind)).withColumn("_side", F.lit(1))
    m = marks.select(*by, F.col(mark).alias("_t"), F.col(mark).alias("_m"))
    both = e.unionByName(m.withColumn("_side", F.lit(0)), allowMissingColumns=True).unionByName(m.withColumn("_side", F.lit(2)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side")
    before = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("before", before).withColumn("after", after).where("_side = 1").select(*events.columns, "before", "after")


def contained_in_one(items: DataFrame, ranges: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """Items inside ONE of their group's ranges as they stand (not inside a union of them). Of the ranges that start at or
    before an item, the one that reaches farthest decides, so a running maximum answers it without a band join."""
    e = items.withColumn("_t", F.col(lo)).withColumn("_r", F.lit(None).cast(ranges.schema[hi].dataType)).withColumn("_side", F.lit(1))
    m = ranges.select(*by, F.col(lo).alias("_t"), F.col(hi).alias("_r")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(m, allowMissingColumns=True).withColumn("_end", F.max("_r").over(w)).where("_side = 1").select(*items.columns, F.coalesce(F.col("_end") >= F.col(hi), F.lit(False)).alias("inside"))


def merge_spans(df: DataFrame, by: list[str], at: str, span: str, anchor: Column, member: Column, widest: int) -> DataFrame:
    """Anchors with the members in their span of up to `widest` places: how many there are and whether each is marked as
    one. A range frame finds them, so no rows are joined."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(1, widest - 1)
    rows = df.withColumn("_a", anchor).withColumn("_next", F.collect_list(F.struct(F.col(at).alias("at"), member.alias("ok"))).over(w)).where("_a")
    m = F.filter("_next", lambda x: x["at"] < F.col(at) + F.col(span))
    return rows.select(*by, at, F.size(m).cast("long").alias("members"), ((F.size(m) == F.col(span) - 1) & F.forall(m, lambda x: x["ok"])).alias("valid"))


def first_found(df: DataFrame, sources: list[tuple[str, DataFrame, Column]], default: str = "unresolved") -> DataFrame:
    """Adds resolved and rank: the value of the first source that has one. sources: (name, DataFrame of k and value, key)."""
    cols, values, ranks = df.columns, [], F.lit(None).cast("string")
    for i, (name, lookup, key) in enumerate(sources):
        df = df.join(lookup.select(F.col("k").alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), key == F.col(f"_k{i}"), "left")
        values.append(F.col(f"_v{i}"))
        ranks = F.coalesce(ranks, F.when(F.col(f"_v{i}").isNotNull(), name))
    return df.select(*cols, F.coalesce(*values, F.lit(default)).alias("resolved"), F.coalesce(ranks, F.lit(default)).alias("rank"))


def usable_aliases(aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """Aliases (k, value) whose value one of the targets (k) is."""
    return aliases.join(targets.select(F.col("k").alias("value")).distinct(), "value", "left_semi")


def latest(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def runs_of(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Stretches of neighbouring rows with one value: first, last, value, items."""
    w = Window.partitionBy(*by).orderBy(order)
    c = df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    c = c.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*by, "_isle").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias(value), F.count("*").alias("items")).drop("_isle")


def numbered(df: DataFrame, by: list[str], order: str, counts: Column) -> DataFrame:
    """The rows that count, numbered from 1; any other row starts the numbers over."""
    w = Window.partitionBy(*by).orderBy(order)
    isle = F.sum(F.when(counts, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_isle", isle).where(counts).withColumn("number", F.row_number().over(Window.partitionBy(*by, "_isle").orderBy(order))).drop("_isle")


def classify(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The class of the first rule whose words a text holds, in any case."""
    low, out = F.lower(text), None
    for part, name in rules:
        hit = F.contains(low, F.lit(part.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def completeness(df: DataFrame, by: list[str], index: str, base: int = 1) -> DataFrame:
    """Whether the indexes of a group are base, base + 1, ... without a gap, and how many repeat."""
    n = F.countDistinct(index)
    return df.groupBy(*by).agg(((n == F.max(index) - base + 1) & (F.min(index) == base)).alias("complete"), (F.count(index) - n).alias("duplicates"))


def first_and_rest(df: DataFrame, by: list[str], order: str, value: str, sep: str = " | ") -> DataFrame:
    """The first value of a group, and the later ones joined in order."""
    n = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    rest = F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") > 1, F.struct("_k", value)))), lambda x: x[value])
    return n.groupBy(*by).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("kept"), F.array_join(rest, sep).alias("appended"))


def rmse(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Root mean square difference of two arrays over all rows of a group, and the number of components."""
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x)
    return df.groupBy(*by).agg(F.round(F.sqrt(F.sum(sq) / F.sum(F.size(a))), 6).alias("rmse"), F.sum(F.size(a)).alias("n"))


def chain_depth(df: DataFrame, ident: str, parent: str, longest: int = 64) -> DataFrame:
    """ident, depth: hops to the end of each row's chain of parents, at most `longest`, so a cycle ends there too."""
    view = f"chain_{abs(hash((ident, parent, id(df))))}"
    df.select(F.col(ident).alias("i"), F.col(parent).alias("p")).createOrReplaceTempView(view)
    return df.sparkSession.sql(f"""WITH RECURSIVE c(i, p, depth) MAX RECURSION LEVEL {longest + 1} AS (SELECT i, p, 0 FROM {view}
 UNION ALL SELECT c.i, x.p, c.depth + 1 FROM c JOIN {view} x ON x.i = c.p WHERE c.depth < {longest})
SELECT i AS {ident}, max(depth) AS depth FROM c GROUP BY i""")


ACTIVE = ("macro", "newmac", "frmmac")


def preflight(inspected: DataFrame, unknown: DataFrame, key: str) -> DataFrame:
    """key, blocked: why a document mustn't be opened by the original program: active sections, an outside style sheet, a
    printer, dynamic fields."""
    u = unknown.groupBy(key).agg(F.max((F.col("type") == "known-opaque-section") & F.lower("section").isin("prn", "port")).alias("_printer"), F.max((F.col("type") == "inline-tag") & F.col("raw").rlike("<:[XZDP]")).alias("_dynamic"))
    active = F.size(F.array_intersect(F.map_keys("section_counts"), F.array(*map(F.lit, ACTIVE)))) > 0
    j = inspected.select(key, active.alias("_active"), (F.coalesce(F.col("metadata")["stylesheet"], F.lit("")) != "").alias("_sheet")).join(u, key, "left")
    found = F.array_compact(F.array(F.when(F.col("_active"), "active-section"), F.when(F.col("_dynamic"), "dynamic-field"), F.when(F.col("_printer"), "printer"), F.when(F.col("_sheet"), "external-stylesheet")))
    return j.select(key, found.alias("blocked"))
