"""Queries over the supplied tables for the operators that need no documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import generic as g

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1), s AS (SELECT * FROM c WHERE n >= 5 ORDER BY n DESC, value LIMIT 32)
SELECT value, n::BIGINT AS n, ((SELECT sum(n) FROM c) - (SELECT coalesce(sum(n), 0) FROM s))::BIGINT AS suppressed_rows, (SELECT count(*) FROM c)::BIGINT AS groups FROM s""")
def suppressed_topk_types(spark, d):
    return g.suppressed_topk(t(spark, d, "part"), "p_type")


@query("""WITH c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT * FROM c WHERE n >= 5 ORDER BY n DESC, value LIMIT 5)
SELECT value, n::BIGINT AS n, ((SELECT sum(n) FROM c) - (SELECT coalesce(sum(n), 0) FROM s))::BIGINT AS suppressed_rows, (SELECT count(*) FROM c)::BIGINT AS groups FROM s""")
def top_widths(spark, d):
    return g.suppressed_topk(t(spark, d, "lineitem"), "l_quantity", k=5)


@query("SELECT count(l_quantity)::BIGINT AS n, min(l_quantity) AS low, median(l_quantity) AS median, max(l_quantity) AS high FROM lineitem")
def numeric_distribution(spark, d):
    return g.distribution(t(spark, d, "lineitem"), "l_quantity")


@query("SELECT l_returnflag, min(l_discount) AS low, median(l_discount) AS median, max(l_discount) AS high FROM lineitem GROUP BY 1")
def quantiles_by_flag(spark, d):
    return g.distribution(t(spark, d, "lineitem"), "l_discount", ["l_returnflag"]).drop("n")


@query("""SELECT l_linestatus, round(CASE WHEN count(*) >= 2 AND var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) END, 6) AS r, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def pearson_guarded(spark, d):
    return g.pearson(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_linestatus"]).withColumn("r", F.round("r", 6))


@query("""SELECT b::INT AS bit, sum((l_partkey >> b) & 1)::BIGINT AS n FROM lineitem, range(31) r(b) GROUP BY b HAVING sum((l_partkey >> b) & 1) >= 5""")
def bit_frequency(spark, d):
    return g.bit_frequency(t(spark, d, "lineitem"), "l_partkey")


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY ALL), m AS (SELECT p_brand, p_size AS mode FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_size) = 1)
SELECT c.p_brand, m.mode, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (p_size % mode = 0), 0)::BIGINT AS multiples FROM c JOIN m USING (p_brand) GROUP BY ALL""")
def mode_multiples(spark, d):
    return g.mode_multiples(t(spark, d, "part"), "p_size", ["p_brand"])


@query("SELECT count(*)::BIGINT AS n, " + ", ".join(f"count(*) FILTER (abs(l_quantity - 25) <= {k})::BIGINT AS within_{k}" for k in range(6)) + " FROM lineitem")
def region_tolerance_bands(spark, d):
    return g.tolerance_bands(t(spark, d, "lineitem"), F.col("l_quantity") - 25, range(6))


@query("""WITH m AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS mark FROM events)
SELECT e.event_id, m.mark AS matched FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.mark""")
def asof_units(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    marks = e.select("user_id", F.date_trunc("hour", "ts").alias("mark")).distinct()
    return g.asof(e, marks, ["user_id"], "ts", "mark").select("event_id", "matched")


@query("""WITH m AS (SELECT user_id, ts AS mark FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT e.event_id, (SELECT min(mark) FROM m WHERE m.user_id = e.user_id AND m.mark > e.ts) AS matched FROM events e""")
def asof_next_boundary(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    first = e.agg(F.min("event_type").alias("first"))
    marks = e.join(F.broadcast(first), F.col("event_type") == F.col("first")).select("user_id", F.col("ts").alias("mark"))
    return g.asof(e, marks, ["user_id"], "ts", "mark", strict=True, forward=True).select("event_id", "matched")


_SPANS = "SELECT o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS lo, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 60)::BIGINT AS hi FROM orders"
_MERGED = f"""WITH s AS ({_SPANS}), r AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM r),
m AS (SELECT o_custkey, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY o_custkey, isle) """


def _spans(spark, d):
    lo = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return t(spark, d, "orders").select("o_custkey", lo.alias("lo"), (lo + 60).alias("hi"))


@query(_MERGED + "SELECT * FROM m")
def interval_merge(spark, d):
    return g.merge_intervals(_spans(spark, d), ["o_custkey"], "lo", "hi")


@query(_MERGED + "SELECT * FROM (SELECT o_custkey, lag(hi) OVER (PARTITION BY o_custkey ORDER BY lo) AS gap_start, lo AS gap_end FROM m) WHERE gap_start IS NOT NULL")
def interval_gaps(spark, d):
    return g.gaps(_spans(spark, d), ["o_custkey"], "lo", "hi")


@query(_MERGED + "SELECT x.o_orderkey, exists(SELECT 1 FROM m WHERE m.o_custkey = x.o_custkey AND m.lo <= x.a AND m.hi >= x.b) AS inside FROM (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 30 AS a, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 90 AS b FROM orders) x")
def interval_containment(spark, d):
    lo = F.unix_date(F.to_date("o_orderdate")).cast("long")
    items = t(spark, d, "orders").select("o_orderkey", "o_custkey", (lo + 30).alias("lo"), (lo + 90).alias("hi"))
    return g.contained(items, _spans(spark, d), ["o_custkey"], "lo", "hi").select("o_orderkey", "inside")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_extendedprice) AS e FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS r FROM l GROUP BY 1),
k AS (SELECT l_orderkey, r, unnest([0, 1]) AS c FROM g)
SELECT k.l_orderkey, r::INT AS row, c::INT AS col, CASE WHEN r % 3 <> 0 THEN CASE c WHEN 0 THEN q ELSE e END END AS value FROM k LEFT JOIN l ON l.l_orderkey = k.l_orderkey AND l_linenumber = r""")
def sparse_grid_fill(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_extendedprice").alias("l_extendedprice"))
    tables = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("rows")).withColumn("cols", F.lit(2))
    cells = li.where("l_linenumber % 3 <> 0").select("l_orderkey", (F.col("l_linenumber") - 1).alias("row"), F.posexplode(F.array("l_quantity", "l_extendedprice")).alias("col", "value"))
    return g.dense_grid(tables, cells, "l_orderkey").withColumn("row", (F.col("row") + 1).cast("int")).select("l_orderkey", "row", "col", "value")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS r, min(l_partkey % 4) AS f, min(l_suppkey % 3 + 1) AS span FROM lineitem GROUP BY ALL),
p AS (SELECT a.l_orderkey, a.r, a.span, count(b.r) AS members, bool_and(b.f <> 0) AS marked FROM a LEFT JOIN a b ON a.l_orderkey = b.l_orderkey AND b.r > a.r AND b.r < a.r + a.span WHERE a.f = 0 GROUP BY ALL)
SELECT l_orderkey, r, members::BIGINT AS members, members = span - 1 AND coalesce(marked, true) AS valid FROM p""")
def merge_spans(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("r")).agg(F.min(F.col("l_partkey") % 4).alias("f"), F.min(F.col("l_suppkey") % 3 + 1).alias("span"))
    return g.merge_spans(a, ["l_orderkey"], "r", "span", F.col("f") == 0, F.col("f") != 0, 3)


@query("""WITH w AS (SELECT p_brand, p_partkey, p_size, sum(p_size) OVER (PARTITION BY p_brand) AS s FROM part), e AS (SELECT *, (p_size * 100000::BIGINT) // s AS b, (p_size * 100000::BIGINT) % s AS r FROM w),
k AS (SELECT *, 100000 - sum(b) OVER (PARTITION BY p_brand) AS left_, row_number() OVER (PARTITION BY p_brand ORDER BY r DESC, p_partkey) AS n FROM e)
SELECT p_partkey, (b + CASE WHEN n <= left_ THEN 1 ELSE 0 END)::BIGINT AS share FROM k""")
def apportion_widths(spark, d):
    return g.apportion(t(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey", 100000).select("p_partkey", F.col("share").cast("long").alias("share"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_nationkey % 5 AS f FROM supplier) SELECT s_suppkey, coalesce(a.n_name, b.r_name, 'unresolved') AS resolved,
CASE WHEN a.n_name IS NOT NULL THEN 'installed' WHEN b.r_name IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS rank FROM s
LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 = 0) a ON a.n_nationkey = s_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) b ON b.r_regionkey = f""")
def priority_resolve(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_nationkey") % 5).alias("f"))
    a = t(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value"))
    b = t(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("value"))
    return g.first_found(s, [("installed", a, F.col("s_nationkey")), ("alias", b, F.col("f"))]).drop("s_nationkey", "f")


@query("SELECT n_name AS value, n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)".replace("n_name AS value", "n_regionkey AS value"))
def usable_aliases(spark, d):
    a = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("value"))
    return g.usable_aliases(a, t(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def anchor_anti_join(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT s_suppkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM supplier JOIN orders ON o_custkey = s_suppkey GROUP BY 1""")
def latest_match(spark, d):
    o = g.latest(t(spark, d, "orders").withColumn("latest", F.col("o_orderkey")), ["o_custkey"], "latest", ["o_orderdate", "o_orderkey"])
    return t(spark, d, "supplier").join(o, F.col("o_custkey") == F.col("s_suppkey")).select("s_suppkey", "latest")


@query("""WITH r AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isle FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, isle ORDER BY turn)::INT AS number FROM r WHERE role = 'assistant'""")
def list_numbering(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    return g.numbered(c, ["conv_id"], "turn", F.col("role") == "assistant").select("conv_id", "turn", "number")


@query("""WITH r AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isle FROM r)
SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, any_value(role) AS role, count(*)::BIGINT AS items FROM i GROUP BY conv_id, isle""")
def list_islands(spark, d):
    r = g.runs_of(t(spark, d, "conversations"), ["conv_id"], "turn", "role")
    return r.select("conv_id", F.col("first").alias("first_turn"), F.col("last").alias("last_turn"), "role", "items")


@query("""SELECT CASE WHEN lower(event_type) LIKE '%pur%' THEN 'conversion' WHEN lower(event_type) LIKE '%cl%' THEN 'interaction' WHEN lower(event_type) LIKE '%v%' THEN 'view' ELSE 'other' END AS failure_class, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def failure_class(spark, d):
    c = g.classify(F.col("event_type"), [("pur", "conversion"), ("cl", "interaction"), ("v", "view")])
    return t(spark, d, "events").groupBy(c.alias("failure_class")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_type || (event_id % 7)::VARCHAR AS c FROM events), g AS (SELECT c, count(DISTINCT user_id) AS units, count(*) AS occurrences FROM e GROUP BY 1)
SELECT c AS class, units::BIGINT AS units, occurrences::BIGINT AS occurrences, round(100.0 * units / (SELECT count(DISTINCT user_id) FROM e)::DOUBLE, 1) AS percent FROM g WHERE units >= 5
UNION ALL SELECT '(suppressed)', count(*)::BIGINT, coalesce(sum(occurrences), 0)::BIGINT, NULL FROM g WHERE units < 5""")
def kanon_aggregate(spark, d):
    e = t(spark, d, "events").select("user_id", F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("c"))
    return g.kanon_groups(e, "user_id", "c")


@query("""SELECT o_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY o_orderkey ORDER BY l_linenumber RANGE UNBOUNDED PRECEDING) <= 100 AS within FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def running_budget(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(Window.unboundedPreceding, 0)
    li, o = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), t(spark, d, "orders").select("o_orderkey")
    n = g.parts(li)
    return li.repartition(n, "l_orderkey").join(o.repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", (F.sum("l_quantity").over(w) <= 100).alias("within"))


@query("""WITH RECURSIVE u AS (SELECT l_orderkey, l_linenumber AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM u),
s AS (SELECT l_orderkey, n, k, CASE WHEN q <= 60 THEN q ELSE 0 END AS used, q <= 60 AS kept FROM l WHERE k = 1
UNION ALL SELECT l.l_orderkey, l.n, l.k, s.used + CASE WHEN s.used + l.q <= 60 THEN l.q ELSE 0 END, s.used + l.q <= 60 FROM s JOIN l ON l.l_orderkey = s.l_orderkey AND l.k = s.k + 1)
SELECT l_orderkey, n::BIGINT AS n, kept FROM s""")
def greedy_text_budget(spark, d):
    li = t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).agg(F.sum("l_quantity").alias("l_quantity"))
    return g.greedy_budget(li, ["l_orderkey"], "n", "l_quantity", 60)


@query("""SELECT l_orderkey, count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AS complete, (count(*) - count(DISTINCT l_linenumber))::BIGINT AS duplicates FROM lineitem GROUP BY 1""")
def index_completeness(spark, d):
    return g.completeness(t(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) SELECT n_regionkey, max(n_name) FILTER (k = 1) AS kept, string_agg(n_name, ' | ' ORDER BY k) FILTER (k > 1) AS appended FROM n GROUP BY 1""")
def duplicate_coordinates(spark, d):
    return g.first_and_rest(t(spark, d, "nation"), ["n_regionkey"], "n_nationkey", "n_name")


@query("""SELECT '#' || lower(lpad(to_hex(p_partkey * 7919 & 255), 2, '0') || lpad(to_hex((p_partkey * 7919 >> 8) & 255), 2, '0') || lpad(to_hex((p_partkey * 7919 >> 16) & 255), 2, '0')) AS colour, p_partkey, p_size / 20.0::DOUBLE AS size_pt, p_size / 1440.0::DOUBLE AS size_in, (p_size & 1) <> 0 AS bold, (p_size & 2) <> 0 AS italic FROM part""")
def style_record_fields(spark, d):
    p = t(spark, d, "part")
    f = scalars.font_flags(F.col("p_size"))
    return p.select("p_partkey", scalars.colour(F.col("p_partkey") * 7919).alias("colour"), scalars.points(F.col("p_size")).alias("size_pt"), scalars.inches(F.col("p_size")).alias("size_in"), f["bold"].alias("bold"), f["italic"].alias("italic"))


@query("""SELECT p_partkey, CASE WHEN v BETWEEN 1 AND 7 THEN v END AS paper_code, CASE WHEN f & 256 <> 0 THEN 'landscape' ELSE 'portrait' END AS orientation, f & 512 = 0 AS alternating, f & 1024 <> 0 AS mirrored,
CASE WHEN f & 16 <> 0 OR f & 12 = 12 THEN 'odd-even' WHEN f & 4 <> 0 THEN 'odd' WHEN f & 8 <> 0 THEN 'even' ELSE 'all' END AS placement
FROM (SELECT p_partkey, p_partkey * 131 AS f, (p_partkey * 131) & 255 AS v FROM part)""")
def layout_flags(spark, d):
    f = F.col("p_partkey") * 131
    p = scalars.paper(f)
    return t(spark, d, "part").select("p_partkey", p["paper_code"].alias("paper_code"), p["orientation"].alias("orientation"), p["alternating"].alias("alternating"), p["mirrored"].alias("mirrored"), scalars.placement(f).alias("placement"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN full_ THEN 0 WHEN NOT bad THEN x END::BIGINT AS lft, CASE WHEN full_ THEN 0 WHEN NOT bad THEN greatest(0, 40 - x - w) END::BIGINT AS rgt, CASE WHEN full_ THEN x WHEN NOT bad THEN 0 END::BIGINT AS first
FROM (SELECT *, abs(w - 40) <= 3 AS full_, x >= 40 OR x + w > 43 AS bad FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 60 AS x, l_quantity::BIGINT AS w FROM lineitem))""")
def region_margins(spark, d):
    m = scalars.region_margins(F.col("l_suppkey") % 60, F.col("l_quantity").cast("long"), F.lit(40))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m["left"].alias("lft"), m["right"].alias("rgt"), m["first"].alias("first"))


@query("""SELECT o_orderkey, CASE WHEN regexp_full_match(s, '[+-]?[0-9]{1,20}') AND abs(s::HUGEINT) <= 2147483647 THEN s::BIGINT END AS value FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '-' || o_custkey::VARCHAR WHEN 2 THEN o_custkey::VARCHAR || '0000000000' ELSE o_orderpriority END AS s FROM orders)""")
def bounded_integers(spark, d):
    k = F.col("o_custkey").cast("string")
    s = F.when(F.col("o_orderkey") % 4 == 0, k).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("-"), k)).when(F.col("o_orderkey") % 4 == 2, F.concat(k, F.lit("0000000000"))).otherwise(F.col("o_orderpriority"))
    return t(spark, d, "orders").select("o_orderkey", scalars.bounded_int(s).alias("value"))


@query("SELECT label::INT AS label, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, count(*)::BIGINT AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS a, unnest(list_concat(embedding[2:], embedding[1:1]))::DOUBLE AS b FROM embeddings) GROUP BY 1")
def raster_rmse(spark, d):
    e = t(spark, d, "embeddings").withColumn("turned", F.concat(F.expr("slice(embedding, 2, size(embedding))"), F.slice("embedding", 1, 1)))
    return g.rmse(e, ["label"], "embedding", "turned")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def media_inventory(spark, d):
    from ..sources.legacy import inventory

    return inventory(t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b")), "doc_id", "b")


@query("""SELECT lower(source) || '.txt' AS dest, count(*)::BIGINT AS inputs FROM documents GROUP BY 1 HAVING count(*) > 1""")
def output_collisions(spark, d):
    return t(spark, d, "documents").groupBy(F.concat(F.lower("source"), F.lit(".txt")).alias("dest")).agg(F.count("*").alias("inputs")).where("inputs > 1")


@query("""SELECT d.doc_id, l.quality IS NULL AS fresh FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL OR l.quality = 0""")
def resume_plan(spark, d):
    done = t(spark, d, "labels").select("doc_id", "quality")
    return t(spark, d, "documents").select("doc_id").join(done, "doc_id", "left").where("quality is null or quality = 0").select("doc_id", F.col("quality").isNull().alias("fresh"))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey // 2 END AS parent FROM supplier), c AS (SELECT s_suppkey, parent, 0 AS depth FROM p UNION ALL SELECT c.s_suppkey, p.parent, c.depth + 1 FROM c JOIN p ON p.s_suppkey = c.parent WHERE c.depth < 64)
SELECT s_suppkey, max(depth)::INT AS depth FROM c GROUP BY 1""")
def style_chain_depth(spark, d):
    return g.chain_depth(t(spark, d, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey div 2 END AS parent"), "s_suppkey", "parent")


@query("""SELECT sha256('{"count":' || count(*)::VARCHAR || ',"keys":' || sum(n_nationkey)::VARCHAR || '}') AS identity FROM nation""")
def canonical_identity(spark, d):
    return t(spark, d, "nation").agg(F.count("*").alias("count"), F.sum("n_nationkey").alias("keys")).select(F.sha2(F.to_json(F.struct("count", "keys")), 256).alias("identity"))


@query("""SELECT page_id, regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', chr(65533), 'g') AS escaped FROM pages""")
def html_escape(spark, d):
    return t(spark, d, "pages").select("page_id", scalars.escape_html(F.col("html")).alias("escaped"))


@query("""SELECT doc_id, (length(text) - length(replace(text, ' ', '')) + 1)::INT AS pieces, p::INT AS page FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents)""")
def text_pages(spark, d):
    pages = t(spark, d, "documents").select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit("\f")), "\f").alias("p")).select("doc_id", F.posexplode("p").alias("page", "text"))
    return pages.select("doc_id", "page", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).alias("pieces"))


@query()
def font_families(spark, d):
    return t(spark, d, "part").groupBy(scalars.fold_family(F.col("p_name")).alias("family")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(value) IS NOT NULL AS has_value FROM events GROUP BY 1")
def incremental_counts(spark, d):
    from ..streaming.incremental import counts

    return counts(spark, f"{d}/events.parquet")


@query("""WITH m AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS mark FROM events WHERE event_id % 3 = 0)
SELECT e.event_id, (SELECT max(mark) FROM m WHERE m.user_id = e.user_id AND m.mark <= e.ts) AS before, (SELECT min(mark) FROM m WHERE m.user_id = e.user_id AND m.mark >= e.ts) AS after FROM events e""")
def asof_both_sides(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    marks = e.where("event_id % 3 = 0").select("user_id", F.date_trunc("hour", "ts").alias("mark")).distinct()
    return g.asof_both(e, marks, ["user_id"], "ts", "mark").select("event_id", "before", "after")


@query(f"WITH s AS ({_SPANS}) SELECT x.o_orderkey, exists(SELECT 1 FROM s WHERE s.o_custkey = x.o_custkey AND s.lo <= x.a AND s.hi >= x.b) AS inside FROM (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 30 AS a, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 75 AS b FROM orders) x")
def interval_in_one_range(spark, d):
    lo = F.unix_date(F.to_date("o_orderdate")).cast("long")
    items = t(spark, d, "orders").select("o_orderkey", "o_custkey", (lo + 30).alias("lo"), (lo + 75).alias("hi"))
    return g.contained_in_one(items, _spans(spark, d), ["o_custkey"], "lo", "hi").select("o_orderkey", "inside")


@query("""SELECT page_id, md5(trim(regexp_replace(html, '\\s+', ' ', 'g'))) AS collapsed, md5(regexp_replace(html, '\\n+$', '')) AS trimmed FROM pages""")
def normalized_text(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", F.md5(scalars.normalize_text(F.col("html"), "collapse")).alias("collapsed"), F.md5(scalars.normalize_text(F.col("html"), "trailing-newline")).alias("trimmed"))


@query()
def text_digests(spark, d):
    return t(spark, d, "pages").select("page_id", scalars.text_digest(F.col("html")).alias("digest"))


@query("SELECT p_partkey, round((w / 96.0) * least(1.0, 6.5 / (w / 96.0), 8.0 / (h / 96.0)), 6)::DOUBLE AS width_in, round((h / 96.0) * least(1.0, 6.5 / (w / 96.0), 8.0 / (h / 96.0)), 6)::DOUBLE AS height_in FROM (SELECT p_partkey, (p_size * 40 + 1)::DOUBLE AS w, (p_partkey % 1000 + 1)::DOUBLE AS h FROM part)")
def display_sizes(spark, d):
    s = scalars.display_size(F.col("p_size") * 40 + 1, F.col("p_partkey") % 1000 + 1)
    return t(spark, d, "part").select("p_partkey", F.round(s["width_in"], 6).alias("width_in"), F.round(s["height_in"], 6).alias("height_in"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END::BIGINT AS at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END::BIGINT AS size FROM orders")
def manifest_rows(spark, d):
    line = F.concat(F.lit(" 1 "), F.when(F.col("o_orderkey") % 3 == 0, "bmp").otherwise(".bmp"), F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" 0 0"))
    m = scalars.manifest_row(line)
    return t(spark, d, "orders").select("o_orderkey", m["at"].cast("long").alias("at"), m["size"].cast("long").alias("size"))


@query("SELECT p, k AS placement, k IN ('all', 'odd-even') OR (k = 'odd' AND p % 2 = 1) OR (k = 'even' AND p % 2 = 0) AS applies FROM (SELECT DISTINCT l_linenumber AS p FROM lineitem), (VALUES ('all'), ('odd'), ('even'), ('odd-even'), ('unknown')) v(k)")
def page_furniture(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("p")).distinct().withColumn("placement", F.explode(F.array(*map(F.lit, ("all", "odd", "even", "odd-even", "unknown")))))
    return p.select("p", "placement", scalars.applies_to_page(F.col("placement"), F.col("p")).alias("applies"))


@query("SELECT s AS style, CASE WHEN s IN ('Heading 3', 'my h-3') THEN 3 WHEN s IN ('Title', 'Chapter  Title') THEN 1 WHEN s = 'Subhead' THEN 2 WHEN s LIKE 'Head%' THEN n % 6 + 1 END::INT AS level FROM (SELECT n_nationkey AS n, CASE n_nationkey % 7 WHEN 0 THEN 'Heading 3' WHEN 1 THEN 'my h-3' WHEN 2 THEN 'Title' WHEN 3 THEN 'Chapter  Title' WHEN 4 THEN 'Subhead' WHEN 5 THEN 'Body' ELSE 'Head:' || (n_nationkey % 6 + 1) END AS s FROM nation)")
def heading_styles(spark, d):
    k = F.col("n_nationkey") % 7
    s = F.when(k == 0, "Heading 3").when(k == 1, "my h-3").when(k == 2, "Title").when(k == 3, "Chapter  Title").when(k == 4, "Subhead").when(k == 5, "Body").otherwise(F.concat(F.lit("Head:"), (F.col("n_nationkey") % 6 + 1).cast("string")))
    return t(spark, d, "nation").select(s.alias("style")).withColumn("level", scalars.heading_level(F.col("style")))


# --- comparison and batches ------------------------------------------------------------------------------------


def _analyses(spark, d, shift=False) -> DataFrame:
    """A job per order, a page per line (in order of its columns), a box per page; the shifted ones are moved, renamed or
    missing by l_partkey."""
    li = t(spark, d, "lineitem")
    k = F.col("l_partkey") % 7
    price = F.col("l_extendedprice") / 1000
    moved = price + F.when((k == 1) & F.lit(shift), 2.0).when((k == 2) & F.lit(shift), 0.25).otherwise(0.0)
    word = F.when((k == 3) & F.lit(shift), "other").otherwise(F.col("l_returnflag"))
    boxes = F.array(F.struct(word.alias("text"), moved.alias("x0"), F.lit(1.0).alias("y0"), (price + 50).alias("x1"), F.lit(9.0).alias("y1")))
    boxes = F.when((k == 4) & F.lit(shift), F.concat(boxes, boxes)).otherwise(boxes)
    page = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.lit(600.0) + F.when((k == 5) & F.lit(shift), 3).otherwise(0)).alias("width_pt"), F.lit(800.0).alias("height_pt"), F.when((k == 6) & F.lit(shift), "else").otherwise(F.col("l_linestatus")).alias("text"), boxes.alias("text_boxes"))
    g_ = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return g_.withColumn("pages", F.when((F.col("l_orderkey") % 5 == 0) & F.lit(shift) & (F.size("pages") > 1), F.expr("slice(pages, 1, size(pages) - 1)")).otherwise(F.col("pages")))


_ISSUES = """WITH p AS (SELECT l_orderkey, l_partkey % 7 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS page, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
q AS (SELECT *, l_orderkey % 5 = 0 AND n > 1 AS short FROM p), i AS (SELECT l_orderkey, page, CASE k WHEN 1 THEN 'box-moved' WHEN 3 THEN 'box-text' WHEN 4 THEN 'box-count' WHEN 5 THEN 'page-size' WHEN 6 THEN 'page-text' END AS code FROM q WHERE k IN (1, 3, 4, 5, 6) AND NOT (short AND page = n - 1) UNION ALL SELECT DISTINCT l_orderkey, NULL, 'page-count' FROM q WHERE short) """


def _issues(spark, d) -> DataFrame:
    from . import comparison as c

    return c.compare_pages(_analyses(spark, d), _analyses(spark, d, True), "l_orderkey")


@query(_ISSUES + "SELECT l_orderkey, page::INT AS page, code FROM i")
def page_compare(spark, d):
    return _issues(spark, d).select("l_orderkey", "page", "code")


@query(_ISSUES + "SELECT l_orderkey, code, count(*)::BIGINT AS occurrences, count(DISTINCT page)::BIGINT AS pages FROM i GROUP BY ALL")
def comparison_metrics(spark, d):
    from . import comparison as c

    return c.comparison_metrics(_issues(spark, d), "l_orderkey")


_AGG = _ISSUES + ", g AS (SELECT code, count(DISTINCT l_orderkey) AS documents, count(*) AS occurrences FROM i GROUP BY 1), a AS (SELECT code, documents, occurrences, round(100.0 * documents / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE, 1) AS percent, row_number() OVER (ORDER BY documents DESC, occurrences DESC, code) AS rank FROM g WHERE documents >= 5) "


@query(_AGG + "SELECT code, documents::BIGINT AS documents, occurrences::BIGINT AS occurrences, percent, rank::INT AS rank FROM a UNION ALL SELECT '(suppressed)', count(*)::BIGINT, coalesce(sum(occurrences), 0)::BIGINT, NULL, NULL FROM g WHERE documents < 5")
def mismatch_aggregate(spark, d):
    from . import comparison as c

    a = c.mismatch_aggregate(_issues(spark, d), t(spark, d, "lineitem").select("l_orderkey").distinct(), "l_orderkey")
    c.audit_aggregate(a)
    return a


@query(_AGG + "SELECT code, 'fix ' || code AS target, row_number() OVER (ORDER BY rank)::INT AS priority FROM (SELECT * FROM a ORDER BY rank LIMIT 3) WHERE code LIKE '%box%' OR code LIKE 'page-t%'")
def mismatch_priorities(spark, d):
    from . import comparison as c

    a = c.mismatch_aggregate(_issues(spark, d), t(spark, d, "lineitem").select("l_orderkey").distinct(), "l_orderkey")
    targets = spark.createDataFrame([(x, f"fix {x}") for x in ("box-moved", "box-text", "box-count", "page-text")], "code string, target string")
    return c.priorities(a, targets, 3)


@query("""SELECT 'c/' || c_name || CASE WHEN c_custkey % 4 = 0 THEN '.txt' ELSE '.sam' END AS path, 'c/' || c_name || '.txt' AS destination, CASE WHEN c_custkey % 4 = 0 THEN 'overwrites-input' WHEN c_custkey % 3 = 0 THEN 'exists' ELSE 'ok' END AS verdict FROM customer""")
def output_plan(spark, d):
    from . import comparison as c

    x = t(spark, d, "customer")
    inputs = x.select(F.concat(F.lit("c/"), F.col("c_name"), F.when(F.col("c_custkey") % 4 == 0, ".txt").otherwise(".sam")).alias("path"))
    return c.plan_outputs(inputs, x.where("c_custkey % 3 = 0").select(F.concat(F.lit("C/"), F.col("c_name"), F.lit(".TXT")).alias("path")), ".txt")


@query("""SELECT o_orderkey AS index, CASE WHEN o_orderkey % 5 = 0 THEN 'run' WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'mismatch' WHEN o_orderkey % 3 = 0 THEN 'retry' ELSE 'keep' END AS action FROM orders""")
def resume_verified(spark, d):
    from . import comparison as c

    o = t(spark, d, "orders")
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    plan = o.select(F.col("o_orderkey").alias("index"), sha.alias("sha256"))
    results = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("index"), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(sha).alias("sha256"), F.when(F.col("o_orderkey") % 11 == 0, "old").otherwise("now").alias("run_digest"), F.when(F.col("o_orderkey") % 3 == 0, "analysis-failure").when(F.col("o_orderkey") % 2 == 0, "compared").otherwise("conversion-failure").alias("status"))
    return c.resume(plan, results, "now")


@query("""SELECT count(*)::BIGINT AS planned, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS successes, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS failures, count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))::BIGINT AS pending, coalesce(sum(o_custkey % 3) FILTER (o_orderstatus IN ('F', 'O')), 0)::BIGINT AS warnings,
CASE WHEN count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) > 0 THEN 'incomplete' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'completed-with-failures' ELSE 'completed' END AS state FROM orders""")
def batch_summary(spark, d):
    from . import comparison as c

    o = t(spark, d, "orders")
    jobs = o.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("index"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failure").alias("status"), (F.col("o_custkey") % 3).alias("warnings"))
    return c.batch_summary(o.select(F.col("o_orderkey").alias("index")), jobs)


@query("""WITH r AS (SELECT s_suppkey AS index, CASE WHEN s_suppkey % 4 = 3 THEN 'failure' ELSE 'success' END AS status, CASE WHEN s_suppkey % 9 = 8 THEN 'b' ELSE 'a' END AS profile, s_suppkey % 5 = 4 AS other FROM supplier)
SELECT index, status, profile, CASE WHEN other THEN 'identity' WHEN status = 'success' AND profile <> (SELECT arg_min(profile, index) FROM r WHERE status = 'success') THEN 'profile' END AS reason FROM r""")
def native_selection(spark, d):
    from . import comparison as c

    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("index"), F.sha2(F.col("s_suppkey").cast("string"), 256).alias("sha256"))
    journal = s.withColumn("sha256", F.when(F.col("index") % 5 == 4, "x").otherwise(F.col("sha256")))
    results = s.withColumn("status", F.when(F.col("index") % 4 == 3, "failure").otherwise("success")).withColumn("profile", F.when(F.col("index") % 9 == 8, "b").otherwise("a"))
    return c.select_native(s, journal, results)


@query("""SELECT doc_id, p::INT AS page, x AS text, len(string_split(text, chr(10))) % 2 = 1 AS matches FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents)""")
def form_feed_pages(spark, d):
    from . import comparison as c

    x = t(spark, d, "documents").select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\f")), F.when(F.contains("text", F.lit("\n")), "\f").otherwise("")).alias("feed"), (F.size(F.split("text", "\n")) % 2 == 1).alias("odd"))
    return c.text_pages(x, "doc_id", "feed", F.when(F.col("odd"), F.size("_p")).otherwise(-1))


@query("SELECT c_custkey, 'ok' AS status, 2::INT AS width, 1::INT AS height, lower(lpad(to_hex(c_custkey % 256), 2, '0') || lpad(to_hex(c_custkey // 256 % 256), 2, '0') || '07' || 'ff' || '010203ff') AS rgba FROM customer")
def png_decode(spark, d):
    """A PNG of two pixels per customer, written by the engine's own writer and decoded again."""
    from ..parsing.render import png
    from . import comparison as c

    @F.pandas_udf("binary")
    def make(k: pd.Series) -> pd.Series:
        return k.map(lambda x: png(2, 1, bytes((x % 256, x // 256 % 256, 7, 1, 2, 3))))

    p = t(spark, d, "customer").select("c_custkey", c.read_png(make("c_custkey")).alias("p"))
    return p.select("c_custkey", "p.status", "p.width", "p.height", F.lower(F.hex("p.rgba")).alias("rgba"))


@query("SELECT c_custkey, round(sqrt((pow(c_custkey % 50, 2) * 3) / 3 / 2) / 255, 9) AS rmse, CASE WHEN c_custkey % 50 > 12.75 THEN 0.5 ELSE 0.0 END AS ratio FROM customer")
def raster_difference(spark, d):
    """Two pictures of two pixels that differ in one by c_custkey % 50 in every channel."""
    from . import comparison as c

    h = F.lpad(F.hex(F.col("c_custkey") % 50), 2, "0")
    x = t(spark, d, "customer").select("c_custkey", F.unhex(F.lit("000000FF000000FF")).alias("a"), F.unhex(F.concat(F.lit("000000FF"), h, h, h, F.lit("00"))).alias("b"))
    return c.raster_difference(x, "a", "b").select("c_custkey", "rmse", "ratio")


@query("SELECT count(*) FILTER (c_custkey % 3 = 0)::BIGINT AS documents, count(*) FILTER (c_custkey % 3 = 1)::BIGINT AS other, count(*) FILTER (c_custkey % 3 = 2)::BIGINT AS bare, 0::BIGINT AS collisions, true AS accepted FROM customer")
def enumeration(spark, d):
    from ..sources.legacy import enumeration as run

    k = F.col("c_custkey") % 3
    return run(t(spark, d, "customer").select(F.concat("c_name", F.when(k == 0, ".SAM").when(k == 1, ".txt").otherwise("")).alias("path")))


@query()
def set_digest(spark, d):
    from ..sources.legacy import inventory, inventory_digest

    return inventory_digest(inventory(t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b")), "doc_id", "b"), "doc_id")
