"""Comparing page analyses, resuming batches, and publishing aggregates that can't be traced to a document."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANALYSIS = "job string, page_count int, pages array<struct<number:int,width_pt:double,height_pt:double,text:string,text_boxes:array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>>"
BOX_TOLERANCE, RMSE_LIMIT, PIXEL_LIMIT, RATIO_LIMIT, LEAST = 0.5, 0.01, 0.05, 0.001, 5
PNG = "status string, width int, height int, rgba binary"
FINAL = ("compared", "conversion-failure")


# --- sources -------------------------------------------------------------------------------------------------


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Page analyses from JSON files, with an explicit schema; a file that isn't one is a row with a reason."""
    raw = spark.read.option("multiLine", "true").schema(ANALYSIS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    wrong = F.when(F.col("_bad").isNotNull(), "not-json").when(F.col("pages").isNull(), "no-pages").when(F.size("pages") != F.col("page_count"), "page-count-mismatch")
    return raw.select("job", "page_count", "pages", wrong.alias("reason"))


def verified(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Manifest rows (key, sha256, size) against the files' own: ok, missing or different."""
    f = files.select(key, F.sha2("content", 256).alias("_sha"), F.length("content").cast("long").alias("_size"))
    j = manifest.join(f, key, "left")
    return j.select(*manifest.columns, F.when(F.col("_sha").isNull(), "missing").when((F.col("_sha") != F.lower("sha256")) | (F.col("_size") != F.col("size")), "different").otherwise("ok").alias("verdict"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Words with their boxes from bounding-box XML: page (from 1), word (from 0), text, box, and whether it is finite, not empty and on the page."""
    p = spark.read.format("xml").option("rowTag", "page").schema("_width double, _height double, word array<struct<_VALUE:string,_xMin:double,_yMin:double,_xMax:double,_yMax:double>>").load(path)
    p = p.withColumn("page", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # one file's pages
    w = p.select("page", "_width", "_height", F.posexplode("word").alias("word", "w"))
    x0, y0, x1, y1 = (F.col(f"w._{k}") for k in ("xMin", "yMin", "xMax", "yMax"))
    finite = ~(F.isnan(x0) | F.isnan(y0) | F.isnan(x1) | F.isnan(y1)) & (F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1)) < 1e9)
    return w.select("page", "word", F.col("w._VALUE").alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (finite & (x0 >= 0) & (y0 >= 0) & (x1 > x0) & (y1 > y0) & (x1 <= F.col("_width")) & (y1 <= F.col("_height"))).alias("valid"))


def text_pages(df: DataFrame, key: str, text: str, expected: Column | None = None) -> DataFrame:
    """key, page (from 0), text: what form feeds separate, without an empty last page; matches says whether the number of
    pages is the expected one."""
    parts = F.split(text, "\f")
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    d = df.withColumn("_p", parts)
    ok = F.lit(None).cast("boolean") if expected is None else F.size("_p") == expected
    return d.select(key, F.posexplode("_p").alias("page", "text"), ok.alias("matches"))


def decode_png(data: bytes | None) -> tuple[str, int | None, int | None, bytes | None]:
    """An 8-bit grey, grey+alpha, RGB, palette or RGBA PNG without interlacing, as RGBA rows; else why not."""
    if data is None or len(data) < 45 or data[:8] != b"\x89PNG\r\n\x1a\n":
        return "not-png", None, None, None
    at, head, palette, alpha, parts = 8, None, b"", b"", []
    while at + 12 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            return "bad-chunk", None, None, None
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = body
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    else:
        return "no-end", None, None, None
    if head is None or len(head) != 13:
        return "no-header", None, None, None
    w, h, depth, colour, _, _, interlace = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), *head[8:]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace or not w or not h or w * h > 100_000_000:
        return "unsupported", w, h, None
    wide = w * channels
    try:
        raw = zlib.decompressobj().decompress(b"".join(parts), (wide + 1) * h + 1)
    except zlib.error:
        return "bad-data", w, h, None
    if len(raw) != (wide + 1) * h:
        return "bad-data", w, h, None
    rows, last = [], bytes(wide)
    for y in range(h):
        f, row = raw[y * (wide + 1)], bytearray(raw[y * (wide + 1) + 1 : (y + 1) * (wide + 1)])
        if f > 4:
            return "bad-filter", w, h, None
        if f:
            for x in range(wide):
                a, b, c = (row[x - channels] if x >= channels else 0), last[x], (last[x - channels] if x >= channels else 0)
                if f == 4:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (row[x] + (a if f == 1 else b if f == 2 else (a + b) // 2 if f == 3 else near)) & 255
        last = bytes(row)
        rows.append(last)
    px = b"".join(rows)
    if colour == 6:
        return "ok", w, h, px
    one = (lambda v: bytes((v[0],) * 3) + b"\xff") if colour == 0 else (lambda v: v + b"\xff") if colour == 2 else (lambda v: bytes((v[0],) * 3) + v[1:]) if colour == 4 else (lambda v: palette[3 * v[0] : 3 * v[0] + 3] + (alpha[v[0] : v[0] + 1] or b"\xff"))
    return "ok", w, h, b"".join(one(px[k : k + channels]) for k in range(0, len(px), channels))


def read_png(content: Column) -> Column:
    @F.pandas_udf(PNG)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_png(None if x is None else bytes(x)) for x in s], columns=["status", "width", "height", "rgba"])

    return run(content)


# --- comparison ----------------------------------------------------------------------------------------------


def compare_pages(expected: DataFrame, actual: DataFrame, key: str, tolerance: float = BOX_TOLERANCE) -> DataFrame:
    """key, page, code, item: where two analyses differ. Both have key and pages (as read_analyses gives them). Pages and
    boxes are compared in order as far as both go; where one has more, that is a row of its own."""
    j = expected.select(key, F.col("pages").alias("e")).join(actual.select(key, F.col("pages").alias("a")), key)
    n = F.least(F.size("e"), F.size("a"))
    counts = j.where(F.size("e") != F.size("a")).select(key, F.lit(None).cast("int").alias("page"), F.lit("page-count").alias("code"), F.lit(None).cast("int").alias("item"))
    p = j.select(key, F.posexplode(F.arrays_zip(F.slice("e", 1, n).alias("e"), F.slice("a", 1, n).alias("a"))).alias("page", "p")).select(key, "page", "p.e", "p.a")
    far = lambda c: F.abs(F.col(f"e.{c}") - F.col(f"a.{c}")) > tolerance
    page_codes = F.array_compact(F.array(F.when(far("width_pt") | far("height_pt"), "page-size"), F.when(~F.col("e.text").eqNullSafe(F.col("a.text")), "page-text"), F.when(F.size("e.text_boxes") != F.size("a.text_boxes"), "box-count")))
    whole = p.select(key, "page", F.explode(page_codes).alias("code"), F.lit(None).cast("int").alias("item"))
    m = F.least(F.size("e.text_boxes"), F.size("a.text_boxes"))
    b = p.select(key, "page", F.posexplode(F.arrays_zip(F.slice("e.text_boxes", F.lit(1), m).alias("x"), F.slice("a.text_boxes", F.lit(1), m).alias("y"))).alias("item", "b"))
    moved = F.lit(False)
    for c in ("x0", "y0", "x1", "y1"):
        moved = moved | (F.abs(F.col(f"b.x.{c}") - F.col(f"b.y.{c}")) > tolerance)
    boxes = b.select(key, "page", F.explode(F.array_compact(F.array(F.when(~F.col("b.x.text").eqNullSafe(F.col("b.y.text")), "box-text"), F.when(moved, "box-moved")))).alias("code"), "item")
    return counts.unionByName(whole).unionByName(boxes)


def raster_difference(df: DataFrame, a: str, b: str, threshold: float = PIXEL_LIMIT) -> DataFrame:
    """Adds rmse (of RGB, as a share of full scale) and ratio (pixels whose largest channel difference exceeds the threshold)
    of two RGBA buffers of one size; null where sizes differ."""
    @F.pandas_udf("rmse double, ratio double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for p, q in zip(x, y):
            if p is None or q is None or len(p) != len(q) or not len(p) or len(p) % 4:
                out.append((None, None))
                continue
            d = np.abs(np.frombuffer(p, np.uint8).reshape(-1, 4)[:, :3].astype(np.int32) - np.frombuffer(q, np.uint8).reshape(-1, 4)[:, :3])
            out.append((round(float(np.sqrt((d.astype(np.float64) ** 2).mean())) / 255, 9), float((d.max(1) > threshold * 255).mean())))
        return pd.DataFrame(out, columns=["rmse", "ratio"]).astype("float64")

    return df.withColumn("_d", run(a, b)).select("*", F.col("_d.rmse").alias("rmse"), F.col("_d.ratio").alias("ratio")).drop("_d")


def comparison_metrics(issues: DataFrame, key: str) -> DataFrame:
    """Per document and code: occurrences and pages affected."""
    return issues.groupBy(key, "code").agg(F.count("*").alias("occurrences"), F.countDistinct("page").alias("pages"))


# --- batches -------------------------------------------------------------------------------------------------


def plan_outputs(inputs: DataFrame, existing: DataFrame, suffix: str, force: bool = False) -> DataFrame:
    """path, destination, verdict for inputs (path): two inputs on one destination, a destination that is an input, one that is
    there already, or ok. existing: path of what is there."""
    dest = F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(suffix))
    d = inputs.select("path", dest.alias("destination"))
    n = d.groupBy(F.lower("destination").alias("_low")).agg(F.count("*").alias("_n"))
    own = inputs.select(F.lower("path").alias("_low"), F.lit(True).alias("_own")).distinct()
    there = existing.select(F.lower("path").alias("_low"), F.lit(True).alias("_there")).distinct()
    j = d.withColumn("_low", F.lower("destination")).join(n, "_low").join(own, "_low", "left").join(there, "_low", "left")
    verdict = F.when(F.col("_own"), "overwrites-input").when(F.col("_n") > 1, "collision").when(F.col("_there") & F.lit(not force), "exists").otherwise("ok")
    return j.select("path", "destination", verdict.alias("verdict"))


def resume(plan: DataFrame, results: DataFrame, run_digest: str, key: str = "index") -> DataFrame:
    """key, action for a plan (key, sha256): results (key, sha256, run_digest, status) of the same run and the same bytes are
    kept if they are final, failures of the analysis are tried again, other results are an error."""
    j = plan.select(key, "sha256").join(results.select(key, F.col("sha256").alias("_sha"), "run_digest", "status"), key, "left")
    action = F.when(F.col("status").isNull(), "run").when((F.col("run_digest") != run_digest) | (F.col("_sha") != F.col("sha256")), "mismatch").when(F.col("status").isin(*FINAL), "keep").otherwise("retry")
    return j.select(key, action.alias("action"))


def select_native(plan: DataFrame, journal: DataFrame, results: DataFrame, key: str = "index") -> DataFrame:
    """Plan, journal and result of each document on one row, with the first reason why they don't fit: another source, or
    another profile than the first success."""
    j = plan.select(key, "sha256").join(journal.select(key, F.col("sha256").alias("_j")), key).join(results.select(key, F.col("sha256").alias("_r"), "status", "profile"), key)
    first = j.where("status = 'success'").agg(F.min_by("profile", key).alias("_first"))
    reason = F.when(~F.col("_j").eqNullSafe(F.col("sha256")) | ~F.col("_r").eqNullSafe(F.col("sha256")), "identity").when((F.col("status") == "success") & ~F.col("profile").eqNullSafe(F.col("_first")), "profile")
    return j.crossJoin(F.broadcast(first)).select(key, "status", "profile", reason.alias("reason"))  # one row


def batch_summary(plan: DataFrame, jobs: DataFrame, key: str = "index") -> DataFrame:
    """One row: successes, failures, warnings, what is pending, and the state of the whole batch."""
    j = plan.select(key).join(jobs.select(key, "status", "warnings"), key, "left")
    s = j.agg(F.count("*").alias("planned"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "failure").alias("failures"), F.count_if(F.col("status").isNull()).alias("pending"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    state = F.when(F.col("pending") > 0, "incomplete").when(F.col("failures") > 0, "completed-with-failures").otherwise("completed")
    return s.withColumn("state", state)


# --- aggregates ----------------------------------------------------------------------------------------------


def mismatch_aggregate(issues: DataFrame, documents: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """Classes of differences seen in at least `least` documents: documents, occurrences, share in per cent, rank; the rarer
    ones are one row of sums. documents: all that were compared."""
    g = issues.groupBy(key, "code").agg(F.count("*").alias("n")).groupBy("code").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))
    total = documents.agg(F.count("*").alias("_total"))
    shown = g.where(F.col("documents") >= least)
    rank = F.row_number().over(Window.orderBy(F.desc("documents"), F.desc("occurrences"), "code"))  # a row a class
    shown = shown.crossJoin(F.broadcast(total)).select("code", "documents", "occurrences", F.bround(100.0 * F.col("documents") / F.col("_total"), 1).alias("percent"), rank.alias("rank"))
    rest = g.where(F.col("documents") < least).agg(F.lit("(suppressed)").alias("code"), F.count("*").alias("documents"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.lit(None).cast("double").alias("percent"), F.lit(None).cast("int").alias("rank"))
    return shown.unionByName(rest)


def priorities(aggregate: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent published classes that have a target (code, target), ranked from 1 without gaps."""
    top = aggregate.where("rank is not null").orderBy("rank").limit(k)  # the report's own limit
    return top.join(F.broadcast(targets), "code").select("code", "target", F.row_number().over(Window.orderBy("rank")).alias("priority"))  # k rows at most


FORBIDDEN = ("path", "source", "text", "name", "sha256", "file")


def audit_aggregate(aggregate: DataFrame, least: int = LEAST) -> None:
    """Raises where an aggregate could give a document away: a column that names one, or a group that is too small."""
    bad = [f for f in aggregate.columns if f.lower() in FORBIDDEN]
    if bad:
        raise ValueError(f"columns {', '.join(bad)} mustn't be published")
    if not aggregate.where((F.col("code") != "(suppressed)") & (F.col("documents") < least)).isEmpty():
        raise ValueError(f"groups of fewer than {least} documents mustn't be published")
