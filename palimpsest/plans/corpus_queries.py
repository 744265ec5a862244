"""Queries that write the supplied tables as legacy documents, run the document engine over them and compare with what SQL
says about the tables: texts, turns, order lines, events, nations and parts become bodies, containers, tables, frames, styles
and page layouts, so every row varies with the data."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import encode_escapes
from ..operators import generic as g
from ..sources import legacy
from ..sources.legacy import CRLF, document_text, tag, to_bytes
from . import engine as E
from . import statistics as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(*xs) -> Column:
    """Lines of a document, each with its break; strings and columns."""
    return F.concat(*[F.concat(x if isinstance(x, Column) else F.lit(x), F.lit(CRLF)) for x in xs])


def joined(df: DataFrame, key: str, order: list[str], piece: Column, sep: str = "") -> DataFrame:
    """key, pieces: the pieces of a key in order (one document's own)."""
    df = df.repartition(key).sortWithinPartitions(key)  # the columns are shuffled, not the longer pieces
    rows = df.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(F.struct(*order, piece.alias("piece")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda s: s["piece"]), sep).alias("pieces"))


# --- texts as bodies -----------------------------------------------------------------------------------------


def corpus(spark, d: str) -> DataFrame:
    return legacy.encode_documents(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "content")


_P = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
_JOINED = f"array_to_string({_P}, chr(10))"


@query(f"SELECT doc_id, 'ok' AS status, len({_P})::BIGINT AS paragraphs, len({_JOINED})::BIGINT AS text_chars, 5::BIGINT AS sections, false AS lossy FROM documents")
def inspect_documents(spark, d):
    return E.inspect(corpus(spark, d)).select("doc_id", "status", F.coalesce(F.col("block_counts")["paragraph"], F.lit(0)).alias("paragraphs"), "text_chars", "sections", "lossy")


@query(f"SELECT count(*)::BIGINT AS files, count(*)::BIGINT AS successful, 0::BIGINT AS failed, sum(len({_JOINED}))::BIGINT AS text_chars, sum(len({_P}))::BIGINT AS paragraphs, count(*)::BIGINT AS infos, 0::BIGINT AS lossy_files FROM documents")
def inspect_summary(spark, d):
    s = E.summary(E.inspect(corpus(spark, d)))
    return s.select("files", "successful", "failed", "text_chars", F.col("block_counts")["paragraph"].alias("paragraphs"), F.col("severity_counts")["info"].alias("infos"), "lossy_files")


@query(f"SELECT doc_id, (i - 1)::INT AS ordinal, p[i] AS text FROM (SELECT doc_id, {_P} AS p FROM documents), range(1, 100000) r(i) WHERE i <= len(p)")
def roundtrip_paragraphs(spark, d):
    return E.relation(corpus(spark, d), "blocks").select("doc_id", "ordinal", "text")


@query(f"SELECT doc_id, array_to_string({_P}, chr(10) || chr(10)) || CASE WHEN {_JOINED} <> '' THEN chr(10) ELSE '' END AS output FROM documents")
def render_text(spark, d):
    return E.renderer("txt")(corpus(spark, d)).select("doc_id", "output")


_MD = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]{}|])', '\\\1', 'g'), '^(\s*)(#{1,6}|[-+])(\s)', '\1\\\2\3'), '^(\s*)(\d+)\.(\s)', '\1\2\\.\3')"""


@query(f"SELECT doc_id, array_to_string(list_transform({_P}, lambda x: {_MD}), chr(10) || chr(10)) || CASE WHEN {_JOINED} <> '' THEN chr(10) ELSE '' END AS output FROM documents")
def render_markdown(spark, d):
    return E.renderer("md")(corpus(spark, d)).select("doc_id", "output")


_HTML = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, coalesce(array_to_string(list_transform({_P}, lambda x: '<p><span style="font-family:Arial,sans-serif;font-size:12pt;color:#000000">' || {_HTML} || '</span></p>' || chr(10)), ''), '') AS main FROM documents""")
def render_html(spark, d):
    """What stands between <main> and </main>."""
    o = E.renderer("html")(corpus(spark, d))
    return o.select("doc_id", F.substring_index(F.substring_index("output", "<main>\n", -1), "</main>", 1).alias("main"))


@query(f"SELECT doc_id, len({_P})::INT AS blocks, md5({_JOINED}) AS text_md5 FROM documents")
def render_json(spark, d):
    o = E.renderer("json")(corpus(spark, d)).select("doc_id", F.from_json("output", "blocks array<struct<kind:string,runs:array<struct<text:string>>>>").alias("j"))
    texts = F.transform("j.blocks", lambda b: F.array_join(F.transform(b["runs"], lambda r: r["text"]), ""))
    return o.select("doc_id", F.size("j.blocks").alias("blocks"), F.md5(F.array_join(texts, "\n")).alias("text_md5"))


def _package_text(rendered: DataFrame, member: str, end: str, kind: str) -> DataFrame:
    """doc_id, paragraphs, text_md5: the paragraphs of packages, read back from their XML one package at a time."""

    def run(batches):
        import hashlib
        import html

        import pyarrow as pa

        for b in batches:
            counts, digests = [], []
            for x in b.column(1):
                xml = zipfile.ZipFile(io.BytesIO(x.as_py())).read(member).decode()
                xml = xml[xml.index(kind) :].replace("<text:s/>", " ").replace("<text:tab/>", "\t")
                texts = [html.unescape(re.sub(r"<[^>]*>", "", p)) for p in re.sub(r"<w:sectPr>.*", "", xml, flags=re.S).split(end)[:-1]]
                counts.append(len(texts))
                digests.append(hashlib.md5("\n".join(texts).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(digests, pa.string())], ["doc_id", "paragraphs", "text_md5"])

    return rendered.select("doc_id", "output").mapInArrow(run, "doc_id long, paragraphs int, text_md5 string")


_PACKAGE = f"SELECT doc_id, len({_P})::INT AS paragraphs, md5({_JOINED}) AS text_md5 FROM documents"


@query(_PACKAGE)
def render_odt(spark, d):
    return _package_text(E.renderer("odt")(corpus(spark, d)), "content.xml", "</text:p>", "<office:body>")


@query(_PACKAGE)
def render_docx(spark, d):
    return _package_text(E.renderer("docx")(corpus(spark, d)), "word/document.xml", "</w:p>", "<w:body>")


@query("SELECT doc_id, true AS is_pdf FROM documents")
def render_pdf(spark, d):
    return E.renderer("pdf")(corpus(spark, d)).select("doc_id", (F.startswith(F.hex("output"), F.lit("255044462D")) & F.endswith(F.hex("output"), F.lit("2525454F460A"))).alias("is_pdf"))


@query(f"SELECT doc_id, (20 + CASE WHEN text = '' THEN 1 ELSE 2 * len(string_split(text, chr(10))) - 1 END)::BIGINT AS n_lines, md5(array_to_string({_P}, chr(10))) AS body_md5 FROM documents")
def line_table(spark, d):
    x = E.relation(corpus(spark, d), "lines")
    per = x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when((F.col("sec_no") == 4) & ~F.col("text").isin("[edoc]", ">", ""), F.struct("line_no", "text")))).alias("x"))
    back = F.transform("x", lambda s: s["text"])
    decoded = F.array_join(back, "\n")
    for a, b in (("<;>", ">"), ("<[>", "["), ("@@", "@"), ("<<", "<")):
        decoded = F.replace(decoded, F.lit(a), F.lit(b))
    return per.select("doc_id", "n_lines", F.md5(decoded).alias("body_md5"))


# --- inline commands -----------------------------------------------------------------------------------------

_MARKS = (("", ""), ("<+!>", "<-!>"), ('<+">', '<-">'), ("<+)>", "<-)>"), ("<+&>", "<:>"), ("<:f400,1Courier>", "<:f>"))
_WORDS = """w AS (SELECT doc_id, l, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, l, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents)))"""


def _marked(spark, d) -> DataFrame:
    """The words of a line in turn plain or in one of five marks; as a paragraph takes 4,095 commands at most, words after
    the 2,000th of a line are plain."""
    mark = lambda i, k: F.when(i < 2000, F.element_at(F.array(*[F.lit(m[k]) for m in _MARKS]), (F.pmod(i, F.lit(len(_MARKS))) + 1).cast("int"))).otherwise("")
    line = lambda x: F.array_join(F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w, i: F.concat(mark(i, 0), encode_escapes(w), mark(i, 1))), " ")
    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), CRLF * 2)
    return t(spark, d, "documents").select("doc_id", to_bytes(document_text(body)).alias("content"))


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, l, string_agg(w, ' ' ORDER BY i) AS line FROM w GROUP BY ALL), x AS (SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY l)) AS text_md5 FROM l GROUP BY 1)
SELECT doc_id, x.text_md5, count(*) FILTER (m = 1)::BIGINT AS bold_runs, sum(CASE WHEN m = 1 THEN len(w) ELSE 0 END)::BIGINT AS bold_chars, count(*) FILTER (m = 2)::BIGINT AS italic_runs, count(*) FILTER (m = 3)::BIGINT AS underline_runs,
count(*) FILTER (m = 4)::BIGINT AS superscript_runs, count(*) FILTER (m = 5)::BIGINT AS courier_runs, max(CASE WHEN m = 5 THEN 20.0 END)::DOUBLE AS courier_size FROM (SELECT *, CASE WHEN i <= 2000 THEN (i - 1) % 6 ELSE 0 END AS m FROM w) JOIN x USING (doc_id) GROUP BY ALL""")
def inline_runs(spark, d):
    r = E.relation(_marked(spark, d), "runs")
    texts = F.array_sort(F.collect_list(F.struct("node", "run_no", "text")))
    a = r.groupBy("doc_id", "node").agg(F.array_join(F.transform(texts, lambda s: s["text"]), "").alias("line"), *[F.count_if(c).alias(c) for c in ("bold", "italic", "underline", "superscript")], F.coalesce(F.sum(F.when(F.col("bold"), F.length("text"))), F.lit(0)).alias("bold_chars"), F.count_if(F.col("family") == "Courier").alias("courier"), F.max(F.when(F.col("family") == "Courier", F.col("size_pt"))).alias("size"))
    s = lambda c: F.sum(c)
    return a.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "line"))), lambda x: x["line"]), "\n")).alias("text_md5"), s("bold").alias("bold_runs"), s("bold_chars").alias("bold_chars"), s("italic").alias("italic_runs"), s("underline").alias("underline_runs"), s("superscript").alias("superscript_runs"), s("courier").alias("courier_runs"), F.max("size").alias("courier_size"))


@query(f"SELECT doc_id, (len({_P}) // 3)::INT AS breaks FROM documents")
def page_breaks(spark, d):
    """Form feeds of the text output where every third paragraph has a page break command."""
    x = t(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda p: p != "").alias("p"))
    body = F.array_join(F.transform("p", lambda p, i: F.concat(F.when(i % 3 == 2, F.lit("<:p>")).otherwise(F.lit("")), encode_escapes(p))), CRLF * 2)
    o = E.renderer("text")(x.select("doc_id", to_bytes(document_text(body)).alias("content")))
    return o.select("doc_id", F.regexp_count("output", F.lit("\f")).alias("breaks"))


@query(f"""SELECT doc_id, (i - 1)::INT AS paragraph, (len(x) * 10)::BIGINT AS x, (1000 + len(x))::BIGINT AS width, ['left', 'right', 'center', 'justify'][(i - 1) % 4 + 1] AS alignment, CASE (i - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE len(x) / 20.0 END::DOUBLE AS spacing, x || '[Current date]' AS text
FROM (SELECT doc_id, unnest({_P}) AS x, generate_subscripts({_P}, 1) AS i FROM documents)""")
def paragraph_commands(spark, d):
    """Region, alignment, spacing and date commands whose values come from the text."""
    x = t(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda p: p != "").alias("p"))
    n = lambda p: F.length(p).cast("string")
    def one(p, i):
        spacing = F.when(i % 3 == 0, "<:S+-1>").when(i % 3 == 1, "<:S+-2>").otherwise(F.concat(F.lit("<:S+"), n(p), F.lit(">")))
        align = F.element_at(F.array(*map(F.lit, ("<+@>", "<+A>", "<+B>", "<+C>"))), (i % 4 + 1).cast("int"))
        return F.concat(F.lit("<:#"), (F.length(p) * 10).cast("string"), F.lit(","), (F.length(p) + 1000).cast("string"), F.lit(">"), spacing, align, encode_escapes(p), F.lit("<:D1>"))

    docs = x.select("doc_id", to_bytes(document_text(F.array_join(F.transform("p", one), CRLF * 2))).alias("content"))
    b = E.relation(docs, "blocks")
    return b.select("doc_id", F.col("ordinal").alias("paragraph"), F.col("region_x").alias("x"), F.col("region_width").alias("width"), "alignment", "spacing", "text")


# --- turns as containers and lists ----------------------------------------------------------------------------


def _conversations(spark, d) -> DataFrame:
    """Turns as notes (user), footnotes (assistant) and headers (system), each followed by a line of text."""
    opener = F.when(F.col("role") == "user", F.concat(F.lit("<:N"), F.col("turn").cast("string"))).when(F.col("role") == "assistant", "<:F").otherwise(F.concat(F.lit("<:H"), (F.col("turn") % 3 * 4).cast("string")))
    inner = F.replace(encode_escapes(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit(CRLF * 2))
    piece = F.concat(lines(F.concat(F.lit("before"), opener), inner, ">"), F.lit("after "), F.col("turn").cast("string"), F.lit(CRLF * 2))
    c = joined(t(spark, d, "conversations"), "conv_id", ["turn"], piece)
    return c.select("conv_id", to_bytes(document_text(F.col("pieces"))).alias("content"))


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'annotation' WHEN 'assistant' THEN 'footnote' ELSE 'header' END AS kind, CASE WHEN role NOT IN ('user', 'assistant') THEN ['all', 'odd', 'even'][turn % 3 + 1] END AS placement, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10)) AS text, 'after ' || turn AS following FROM conversations""")
def body_containers(spark, d):
    b = E.relation(_conversations(spark, d), "blocks", "conv_id")
    inner = b.where("depth = 1").groupBy("conv_id", F.col("parent")[0].alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n").alias("inner"))
    top = b.where("depth = 0")
    boxes = top.where("kind <> 'paragraph'").select("conv_id", "kind", "placement", F.col("ordinal").alias("at"))
    after = top.where("kind = 'paragraph' and text like 'after %'").select("conv_id", (F.col("ordinal") - 1).alias("at"), F.col("text").alias("following"))
    j = boxes.join(inner, ["conv_id", "at"], "left").join(after, ["conv_id", "at"])
    return j.select("conv_id", F.substring("following", 7, 10).cast("long").alias("turn"), "kind", "placement", F.coalesce("inner", F.lit("")).alias("text"), "following")


def _list_documents(spark, d) -> DataFrame:
    style = F.when(F.col("role") == "assistant", "@Number List@").when(F.col("role") == "user", "@Bullet@").otherwise("@Body Text@")
    first = F.concat(F.lit("t"), F.col("turn").cast("string"))
    c = joined(t(spark, d, "conversations"), "conv_id", ["turn"], F.concat(style, first, F.lit(CRLF * 2)))
    styles = [tag("Body Text"), tag("Number List"), tag("Bullet")]
    return c.select("conv_id", to_bytes(document_text(F.col("pieces"), styles=styles)).alias("content"))


_LIST = """WITH r AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isle FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, isle, role = 'assistant' ORDER BY turn) AS n FROM r), m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN n || '. ' WHEN 'user' THEN '- ' ELSE '' END || 't' || turn AS item FROM n)
SELECT conv_id, string_agg(item, chr(10) || chr(10) ORDER BY turn) || chr(10) AS output FROM m GROUP BY 1"""


@query(_LIST)
def list_text(spark, d):
    """Numbers and bullets of the text output: a bullet or plain paragraph starts numbering over."""
    return E.renderer("text")(_list_documents(spark, d), "conv_id").select("conv_id", "output")


@query("""WITH r AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations)
SELECT conv_id, (sum(new) FILTER (role = 'assistant'))::INT AS ordered, (sum(new) FILTER (role = 'user'))::INT AS bullets, (count(*) FILTER (role IN ('user', 'assistant')))::INT AS items FROM r GROUP BY 1""")
def list_html(spark, d):
    """Lists of the HTML output: neighbouring items of one kind are one list."""
    o = E.renderer("html")(_list_documents(spark, d), "conv_id")
    main = F.substring_index("output", "</main>", 1)
    n = lambda s: F.regexp_count(main, F.lit(s))
    return o.select("conv_id", F.nullif(n("<ol>"), F.lit(0)).alias("ordered"), F.nullif(n("<ul>"), F.lit(0)).alias("bullets"), n("<li>").alias("items"))


# --- order lines as tables -----------------------------------------------------------------------------------

_L = "l_linenumber - 1"
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_ORD = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def order_tables(spark, d) -> DataFrame:
    """A document per order: a frame with a table of max(l_linenumber) rows and two columns, a row metric a line, two cells a
    line (the second one missing where l_partkey % 5 = 0), so places are missing and there several times."""
    li = t(spark, d, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey")  # few numbers are shuffled, no texts
    s = lambda x: (F.expr(x) if isinstance(x, str) else x).cast("string")
    row = s(_L)
    metric = lines(F.concat_ws(" ", F.concat(F.lit("\t\t\t"), row), s("200 + cast(l_quantity as int)"), F.lit("10"), s("if(l_linenumber = 1, 16, 0)"), F.lit("0 0 0")))
    cell = lambda c, flags, text: lines(F.concat_ws(" ", F.concat(F.lit("\t\t\t"), row), F.lit(c), s(flags), F.lit("0 0"), s("l_partkey % 12"), s("l_suppkey * 100"), F.lit("1"), s("int(l_partkey % 7 = 0)"), s("l_partkey % 3"), F.lit("0 0")), text, "\t\t\t>")
    body = lambda c: F.concat(F.lit("\t\t\t"), F.when(F.expr("l_quantity % 2 = 1"), "<+A>").otherwise(""), F.col(c))
    cells = F.concat(cell("0", "if(l_quantity % 2 = 1, 16, 8)", body("l_returnflag")), F.when(F.expr("l_partkey % 5 <> 0"), cell("1", "8", body("l_linestatus"))).otherwise(""))
    rows = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.array_sort(F.collect_list(F.struct(*_ORD, metric.alias("m"), cells.alias("c")))).alias("x"))
    pick = lambda f: F.array_join(F.transform("x", lambda r: r[f]), "")
    tail = F.col("l_orderkey") % 50
    frame = F.concat(lines("[frm]", "\t1", "\t524288", "\t0", "\t0", F.concat(F.lit("\t"), (2 * 620 + tail).cast("string")), F.concat(F.lit("\t"), (F.col("n") * 310 + tail + 1).cast("string")), "\t[tbl]", F.concat(F.lit("\t\t"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("2 300 10 600 20 0"), tail.cast("string"), tail.cast("string"))), "\t\t[h]"), pick("m"), lines("\t\t[w]", "\t\t\t0 600 20 0 0", "\t\t\t1 600 20 0 0", "\t[data]"), pick("c"), lines("\t[e]"))
    return rows.select("l_orderkey", to_bytes(document_text(F.lit("<:t0>"), frame)).alias("content"))


_CELLS = f"""c AS (SELECT l_orderkey, r, col, txt, odd, k, l_partkey, l_suppkey, fl, row_number() OVER (PARTITION BY l_orderkey, r, col ORDER BY k) AS dup FROM (SELECT l_orderkey, {_L} AS r, cc AS col, CASE cc WHEN 0 THEN l_returnflag ELSE l_linestatus END AS txt, l_quantity % 2 = 1 AS odd, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}, cc) AS k,
 l_partkey, l_suppkey, CASE WHEN cc = 0 AND l_quantity % 2 = 1 THEN 16 ELSE 8 END AS fl FROM lineitem, (VALUES (0), (1)) v(cc) WHERE cc = 0 OR l_partkey % 5 <> 0))"""
_GRID = f"""WITH {_CELLS}, n AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), p AS (SELECT n.l_orderkey, r, col FROM n, range(7) q(r), (VALUES (0), (1)) v(col) WHERE r < n),
f AS (SELECT p.l_orderkey, p.r, p.col, string_agg(CASE WHEN dup > 1 THEN '[Duplicate table cell coordinate; values retained in source order]' || SEP || txt ELSE txt END, SEP ORDER BY k) AS v FROM p LEFT JOIN c USING (l_orderkey, r, col) GROUP BY ALL), again AS (SELECT l_orderkey, count(*) - count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1), note AS (SELECT l_orderkey, CASE WHEN k > 0 THEN OPEN || 'Unsupported table fields: ' || k || ' field sets kept without interpretation' || SHUT || chr(10) || chr(10) ELSE '' END AS note FROM again) """


@query(f"WITH {_CELLS} SELECT l_orderkey, (k - 1)::INT AS ordinal, r::BIGINT AS row, col::BIGINT AS col, fl::BIGINT AS flags, txt AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS k2 FROM c) WHERE true".replace("(k - 1)::INT", "(k2 - 1)::INT"))
def table_cells(spark, d):
    c = E.relation(order_tables(spark, d), "cells", "l_orderkey")
    return c.select("l_orderkey", "ordinal", "row", "col", F.col("fields")[2].alias("flags"), "text")


@query(_GRID.replace("SEP", "' / '").replace("OPEN", "'['").replace("SHUT", "']'") + "SELECT l_orderkey, any_value(note) || string_agg(line, chr(10) ORDER BY r) || chr(10) AS output FROM (SELECT l_orderkey, r, string_agg(coalesce(v, ''), chr(9) ORDER BY col) AS line FROM f GROUP BY ALL) JOIN note USING (l_orderkey) GROUP BY 1")
def table_text(spark, d):
    return E.renderer("text")(order_tables(spark, d), "l_orderkey").select("l_orderkey", "output")


@query(_GRID.replace("SEP", "'<br>'").replace("OPEN", r"'\['").replace("SHUT", r"'\]'").replace("'[Duplicate table cell coordinate; values retained in source order]'", r"'\[Duplicate table cell coordinate; values retained in source order\]'") + "SELECT l_orderkey, any_value(note) || string_agg(line || CASE WHEN r = 0 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY r) || chr(10) AS output FROM (SELECT l_orderkey, r, '| ' || string_agg(coalesce(v, ''), ' | ' ORDER BY col) || ' |' AS line FROM f GROUP BY ALL) JOIN note USING (l_orderkey) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1")
def table_markdown(spark, d):
    """Orders that have a line 1, whose metric marks row 0 as the header."""
    o = E.renderer("markdown")(order_tables(spark, d), "l_orderkey").select("l_orderkey", "output")
    first = t(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey").distinct()
    return o.join(first, "l_orderkey", "left_semi")


@query("""SELECT l_orderkey, max(l_linenumber)::INT AS rows, (2 * max(l_linenumber))::INT AS cells, max(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::INT AS heads FROM lineitem GROUP BY 1""")
def table_html(spark, d):
    o = E.renderer("html")(order_tables(spark, d), "l_orderkey")
    n = lambda s: F.regexp_count("output", F.lit(s))
    return o.select("l_orderkey", n("<tr>").alias("rows"), n("<t[dh][ >]").alias("cells"), n("<thead>").alias("heads"))


def table_relation(spark, d, name: str) -> DataFrame:
    return E.relation(order_tables(spark, d), name, "l_orderkey")


_G = f"""WITH {_CELLS}, n AS (SELECT l_orderkey, max(l_linenumber) AS rows FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, rows, 2 AS cols, rows * 2 AS capacity, count(*) AS cells, count(DISTINCT r * 2 + col) AS places, count(*) FILTER (r < 2 AND col < rows) AS swapped, max(r) AS top_row, max(col) AS top_col, min(r) AS low_row, min(col) AS low_col FROM n JOIN c USING (l_orderkey) GROUP BY ALL) """


@query(_G + "SELECT l_orderkey, rows::INT AS rows, 2::INT AS cols, capacity::BIGINT AS capacity, cells::BIGINT AS cells, places::BIGINT AS places, cells::BIGINT AS inside, swapped::BIGINT AS inside_swapped, places = capacity AS complete FROM g")
def table_grids(spark, d):
    return table_relation(spark, d, "grids").select("l_orderkey", "rows", "cols", "capacity", "cells", "places", "inside", "inside_swapped", "complete")


@query(_G + """SELECT count(*)::BIGINT AS tables, sum(capacity)::BIGINT AS capacity, sum(cells)::BIGINT AS cells, sum(cells)::BIGINT AS inside, count(*)::BIGINT AS tables_all_inside, count(*) FILTER (low_row = 0)::BIGINT AS low_row_zero, count(*) FILTER (low_col = 0)::BIGINT AS low_col_zero, count(*) FILTER (top_row = rows - 1)::BIGINT AS top_row_matches, count(*) FILTER (top_col = 1)::BIGINT AS top_col_matches,
count(*) FILTER (places = capacity)::BIGINT AS complete, sum(cells - places)::BIGINT AS duplicates, sum(swapped)::BIGINT AS inside_swapped, coalesce(sum(cells) FILTER (rows <> 2), 0)::BIGINT AS cells_differing, coalesce(sum(swapped) FILTER (rows <> 2), 0)::BIGINT AS inside_swapped_differing FROM g""")
def coordinate_report(spark, d):
    return S.coordinate_report(table_relation(spark, d, "grids"))


_M = """WITH n AS (SELECT l_orderkey, max(l_linenumber) AS own FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, own, count(*) AS n, count(DISTINCT l_linenumber) AS dist, count(*) FILTER (l_linenumber - 1 < 2) AS other, count(*) FILTER (200 + l_quantity = 300) AS same FROM lineitem JOIN n USING (l_orderkey) GROUP BY ALL) """


@query(_M + """SELECT sum(n)::BIGINT AS records, sum(n)::BIGINT AS compared, sum(n)::BIGINT AS inside, count(*)::BIGINT AS tables_all_inside, count(*) FILTER (dist = own)::BIGINT AS tables_complete, count(*)::BIGINT AS tables_top_matches, sum(n - dist)::BIGINT AS duplicates, sum(other)::BIGINT AS inside_other, count(*) FILTER (other = n)::BIGINT AS tables_all_inside_other,
coalesce(sum(n) FILTER (own <> 2), 0)::BIGINT AS compared_differing, coalesce(sum(other) FILTER (own <> 2), 0)::BIGINT AS inside_other_differing, sum(same)::BIGINT AS default_extent, sum(n)::BIGINT AS default_gutter FROM m""")
def row_index_report(spark, d):
    return S.index_totals(table_relation(spark, d, "indexes").where("family = 'row'"))


@query(_M + """SELECT (2 * count(*))::BIGINT AS records, (2 * count(*))::BIGINT AS compared, (2 * count(*))::BIGINT AS inside, count(*)::BIGINT AS tables_all_inside, count(*)::BIGINT AS tables_complete, count(*)::BIGINT AS tables_top_matches, 0::BIGINT AS duplicates, sum(least(own, 2))::BIGINT AS inside_other, count(*) FILTER (own >= 2)::BIGINT AS tables_all_inside_other,
(2 * count(*) FILTER (own <> 2))::BIGINT AS compared_differing, coalesce(sum(least(own, 2)) FILTER (own <> 2), 0)::BIGINT AS inside_other_differing, (2 * count(*))::BIGINT AS default_extent, (2 * count(*))::BIGINT AS default_gutter FROM m""")
def column_index_report(spark, d):
    return S.index_totals(table_relation(spark, d, "indexes").where("family = 'column'"))


_X = f"""WITH l AS (SELECT l_orderkey, l_linenumber, (200 + l_quantity + 10)::BIGINT AS h, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS k FROM lineitem),
x AS (SELECT l_orderkey, max(l_linenumber) AS n, sum(h) FILTER (k = 1) AS own, count(*) FILTER (k = 1) AS have FROM l GROUP BY 1), e AS (SELECT l_orderkey, own + (n - have) * 310 AS height, 1240 AS width, n * 310 + l_orderkey % 50 + 1 AS outer_height, 1240 + l_orderkey % 50 AS outer_width, l_orderkey % 50 AS tail FROM x) """


@query(_X + "SELECT l_orderkey, height::BIGINT AS height, width::BIGINT AS width, outer_height::BIGINT AS outer_height, outer_width::BIGINT AS outer_width, tail::BIGINT AS tail_1, tail::BIGINT AS tail_2 FROM e")
def table_extents(spark, d):
    return table_relation(spark, d, "extents").drop("table_no")


@query(_X + "SELECT count(*)::BIGINT AS tables, count(*)::BIGINT AS equal_tails, count(*)::BIGINT AS compared, count(*) FILTER (outer_height - height = tail)::BIGINT AS height_exact, count(*) FILTER (abs(outer_height - height - tail) <= 3)::BIGINT AS height_near, count(*)::BIGINT AS width_exact, count(*)::BIGINT AS width_near FROM e")
def tail_report(spark, d):
    return S.tail_report(table_relation(spark, d, "extents"))


@query(f"""WITH {_CELLS} SELECT count(*)::BIGINT AS records, count(*) FILTER (odd)::BIGINT AS alignment_observations, count(*) FILTER (odd AND fl = 16)::BIGINT AS alignment_matches, count(*)::BIGINT AS content_flag_with_text, 0::BIGINT AS content_flag_without_text, 0::BIGINT AS text_without_content_flag, 0::BIGINT AS content_flag_other,
count(*) FILTER (l_partkey % 7 = 0)::BIGINT AS protected, 0::BIGINT AS protected_other, count(*) FILTER (l_partkey % 12 <> 0 AND l_partkey % 3 <> 0)::BIGINT AS shaded_with_r0, count(*) FILTER (l_suppkey * 100 > 65535)::BIGINT AS wide_borders, count(*)::BIGINT AS r1_zero, count(*)::BIGINT AS r2_zero, 0::BIGINT AS with_lines_after FROM c""")
def cell_field_report(spark, d):
    return S.cell_field_report(table_relation(spark, d, "cells"))


@query(f"WITH {_CELLS} SELECT (nib // 4)::INT AS nibble, ((l_suppkey * 100) >> nib & 15)::BIGINT AS value, count(*)::BIGINT AS n FROM c, (VALUES (0), (4), (8), (12)) v(nib) GROUP BY ALL")
def border_nibbles(spark, d):
    return S.border_nibbles(table_relation(spark, d, "cells")).withColumn("nibble", F.col("nibble").cast("int"))


@query("SELECT * FROM (SELECT 'tbl' AS family, 9 AS arity, count(DISTINCT l_orderkey)::BIGINT AS records, count(DISTINCT l_orderkey)::BIGINT AS canonical FROM lineitem UNION ALL SELECT 'h', 7, count(*)::BIGINT, count(*)::BIGINT FROM lineitem UNION ALL SELECT 'w', 5, (2 * count(DISTINCT l_orderkey))::BIGINT, (2 * count(DISTINCT l_orderkey))::BIGINT FROM lineitem) WHERE records >= 5")
def record_shapes(spark, d):
    return S.record_shapes(table_relation(spark, d, "shapes"))


def _merge_tables(spark, d) -> DataFrame:
    """A document per order with a table of one column: a line with l_partkey % 4 = 0 is an anchor over l_suppkey % 3 + 1 rows,
    any other is a member that states its distance from the last anchor and holds text where l_partkey % 4 = 3."""
    li = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.expr("l_partkey % 4 = 0"), F.col("l_linenumber"))).over(w)
    li = li.withColumn("away", F.coalesce(F.col("l_linenumber") - last, F.lit(0)))
    anchor = F.expr("l_partkey % 4 = 0")
    head = F.concat_ws(" ", F.concat(F.lit("\t\t\t"), F.expr("cast(l_linenumber - 1 as string)")), F.lit("0"), F.when(anchor, "256").otherwise("128"), F.when(anchor, F.expr("cast(l_suppkey % 3 + 1 as string)")).otherwise(F.col("away").cast("string")), F.when(anchor, "1").otherwise("0"), F.lit("0 0 0 0 0 0 0"))
    cell = F.concat(lines(head), F.when(F.expr("l_partkey % 4 in (0, 3)"), lines("\t\t\ttext")).otherwise(""), lines("\t\t\t>"))
    n = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("c")))).alias("x"))
    frame = F.concat(lines("[frm]", "\t1", "\t524288", "\t0", "\t0", "\t100", "\t100", "\t[tbl]", F.concat(F.lit("\t\t"), F.col("n").cast("string"), F.lit(" 1 0 0 0 0 0 0 0")), "\t[data]"), F.array_join(F.transform("x", lambda r: r["c"]), ""), lines("\t[e]"))
    return n.select("l_orderkey", to_bytes(document_text(F.lit("<:t0>"), frame)).alias("content"))


# an anchor's rectangle ends before the next anchor or is broken by it, so rectangles never overlap here
_MERGES = """WITH a AS (SELECT l_orderkey, l_linenumber AS r, x.l_partkey % 4 AS f, x.l_suppkey % 3 + 1 AS span FROM (SELECT l_orderkey, l_linenumber, min({'l_partkey': l_partkey, 'l_suppkey': l_suppkey}) AS x FROM lineitem GROUP BY ALL)),
n AS (SELECT l_orderkey, max(r) AS n FROM a GROUP BY 1), b AS (SELECT *, max(CASE WHEN f = 0 THEN r END) OVER (PARTITION BY l_orderkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS home FROM a),
p AS (SELECT x.l_orderkey, x.r, x.span, x.r + x.span - 1 <= n AND count(y.r) FILTER (y.f IN (1, 2)) = x.span - 1 AS ok FROM b x JOIN n USING (l_orderkey) LEFT JOIN b y ON y.l_orderkey = x.l_orderkey AND y.r > x.r AND y.r < x.r + x.span WHERE x.f = 0 GROUP BY x.l_orderkey, x.r, x.span, n) """


@query(_MERGES + "SELECT l_orderkey, (r - 1)::BIGINT AS row, CASE WHEN ok THEN span ELSE 1 END::INT AS row_span FROM p")
def merge_validation(spark, d):
    c = E.relation(_merge_tables(spark, d), "cells", "l_orderkey")
    return c.where((F.col("fields")[2].bitwiseAND(F.lit(256).cast("long"))) != 0).select("l_orderkey", "row", "row_span")


@query(_MERGES + """, q AS (SELECT b.l_orderkey, b.r, b.f, coalesce(p.ok AND b.r < p.r + p.span, false) AS covered FROM b LEFT JOIN p ON p.l_orderkey = b.l_orderkey AND p.r = b.home WHERE f <> 0)
SELECT (SELECT count(*) FROM p)::BIGINT AS anchors, (SELECT count(*) FROM q)::BIGINT AS members, 0::BIGINT AS anchors_with_member_bit, (SELECT count(*) FILTER (ok) FROM p)::BIGINT AS anchors_resolved, (SELECT count(*) FILTER (NOT ok) FROM p)::BIGINT AS anchors_open, (SELECT count(*) FILTER (covered) FROM q)::BIGINT AS members_covered, (SELECT count(*) FILTER (NOT covered) FROM q)::BIGINT AS members_open, (SELECT count(*) FILTER (f <> 3) FROM q)::BIGINT AS members_empty""")
def merge_report(spark, d):
    return S.merge_report(E.relation(_merge_tables(spark, d), "cells", "l_orderkey"))


@query(_MERGES + ", c AS (SELECT span || 'x1' AS value, count(*) AS n FROM p GROUP BY 1), s AS (SELECT * FROM c WHERE n >= 5) SELECT value, n::BIGINT AS n, ((SELECT sum(n) FROM c) - (SELECT coalesce(sum(n), 0) FROM s))::BIGINT AS suppressed_rows, (SELECT count(*) FROM c)::BIGINT AS groups FROM s")
def span_pairs(spark, d):
    return S.span_pairs(E.relation(_merge_tables(spark, d), "cells", "l_orderkey"))


# --- regions and indents --------------------------------------------------------------------------------------


def _region_documents(spark, d) -> DataFrame:
    """A document per customer with a page layout, and a paragraph per order with a region, indents and a font size."""
    o = t(spark, d, "orders")
    p = F.concat(F.lit("<:#"), ((F.col("o_orderkey") % 9 + 1) * 283).cast("string"), F.lit(","), (9000 + F.col("o_orderkey") % 15 - 7 - F.when(F.col("o_orderkey") % 4 == 0, 500).otherwise(0)).cast("string"), F.lit(">"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<:f"), (F.col("o_orderkey") % 7 * 20).cast("string"), F.lit(",1Arial>"))).otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("<:I"), (F.col("o_orderkey") % 2 * 10).cast("string"), F.lit(",5,"), (F.col("o_orderkey") % 3).cast("string"), F.lit(",0>"))).otherwise(""), F.lit("order "), F.col("o_orderstatus"), F.lit(CRLF * 2))
    body = joined(o, "o_custkey", ["o_orderkey"], p)
    lay = lines("[lay]", "\tMain", "\t1", "\t[rght]", *[f"\t\t{x}" for x in (15840, 12000, 0, 1500, 1500, 1, 1500, 1500, 0)])
    return body.select("o_custkey", to_bytes(document_text(F.col("pieces"), lay)).alias("content"))


_R = """WITH r AS (SELECT o_custkey, o_orderkey, (o_orderkey % 9 + 1) * 283 AS x, 9000 + o_orderkey % 15 - 7 - CASE WHEN o_orderkey % 4 = 0 THEN 500 ELSE 0 END AS w, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 * 20 END AS f, len('order' || o_orderstatus) AS m FROM orders),
q AS (SELECT x AS mode FROM r GROUP BY x ORDER BY count(*) DESC, x LIMIT 1) """


@query(_R + """SELECT count(*)::BIGINT AS commands, 0::BIGINT AS zero_width, count(*)::BIGINT AS usable, """ + ", ".join(f"count(*) FILTER (abs(w - 9000) <= {k})::BIGINT AS within_{k}" for k in range(6)) + """, count(*) FILTER (abs(w - 9000) > 5 AND x + w <= 9000)::BIGINT AS far_inside, count(*) FILTER (abs(w - 9000) > 5 AND x + w > 9000)::BIGINT AS far_outside, count(*) FILTER (w > 9005)::BIGINT AS far_wider, 0::BIGINT AS far_beyond, max(mode)::BIGINT AS mode, count(*) FILTER (mode > 0 AND x % nullif(mode, 0) = 0)::BIGINT AS multiples,
count(*) FILTER (f > 0)::BIGINT AS font_linked, count(*) FILTER (f > 0 AND abs(x - 1.18 * f) <= 10)::BIGINT AS near_1_18_within_10, count(*) FILTER (f > 0 AND abs(x - 1.18 * f) <= 20)::BIGINT AS near_1_18_within_20 FROM r, q""")
def region_report(spark, d):
    return S.region_report(E.relation(_region_documents(spark, d), "regions", "o_custkey"))


@query(_R + """, t AS (SELECT w FROM r GROUP BY w ORDER BY count(*) DESC, w LIMIT 5) SELECT w::BIGINT AS width, (x // mode)::BIGINT AS multiple, count(*)::BIGINT AS n, min(m)::INT AS low, median(m) AS median, max(m)::INT AS high FROM r JOIN t USING (w), q WHERE mode > 0 AND x % nullif(mode, 0) = 0 AND x // nullif(mode, 0) BETWEEN 1 AND 6 GROUP BY ALL HAVING count(*) >= 5""")
def region_density(spark, d):
    return S.region_density(E.relation(_region_documents(spark, d), "regions", "o_custkey"))


@query("""WITH i AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0) SELECT count(*)::BIGINT AS commands, count(*) FILTER (o_orderkey % 2 = 0)::BIGINT AS zero_0, 0::BIGINT AS zero_1, count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS zero_2, count(*)::BIGINT AS zero_3, count(*)::BIGINT AS units, 0::BIGINT AS units_with_several, count(*)::BIGINT AS before_material, count(*)::BIGINT AS with_region, count(*) FILTER (o_orderkey % 3 = 0)::BIGINT AS with_font FROM i""")
def indent_report(spark, d):
    return S.indent_report(E.relation(_region_documents(spark, d), "commands", "o_custkey"), "o_custkey")


@query()
def corpus_report(spark, d):
    """The whole report over tables, regions and indents, a struct per part."""
    r = E.together(order_tables(spark, d).withColumnRenamed("l_orderkey", "key"), ("indexes", "grids", "extents", "cells"), "key")
    r |= E.together(_region_documents(spark, d).withColumnRenamed("o_custkey", "key"), ("commands", "regions"), "key")
    return S.corpus_report(r, "key")


# --- damage and loss -----------------------------------------------------------------------------------------

_N = "len(text)"


def _damaged(spark, d) -> DataFrame:
    """Texts whose length decides what is wrong with their document."""
    x = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    part = lambda k, *ls: F.when(n % k == 0, lines(*ls)).otherwise("")
    head = F.concat(part(3, "[strange]", "\tx"), part(4, "[revisions]", "\t1"), part(5, "[macro]", "\trun"), part(6, "[toc]", "\tentry"))
    body = F.concat(F.replace(encode_escapes(F.col("text")), F.lit("\n"), F.lit(CRLF * 2)), F.when(n % 7 == 0, "<:Q1>").otherwise(""), F.when(n % 11 == 0, "@Nowhere@z").otherwise(""), F.when(n % 13 == 0, "<:D1>").otherwise(""))
    whole = document_text(body, head, version=F.when(n % 17 == 0, "9").otherwise("4"))
    whole = F.when(n % 19 == 0, F.replace(whole, F.lit("[ver]"), F.lit("[vex]"))).when(n % 23 == 0, F.replace(whole, F.lit("[sty]"), F.lit("[stx]"))).otherwise(whole)
    return x.select("doc_id", to_bytes(whole).alias("content"))


_OK = f"{_N} % 19 <> 0 AND {_N} % 23 <> 0"
_CODES = {"unknown-section": f"{_N} % 3 = 0", "revisions-opaque": f"{_N} % 4 = 0", "active-content-disabled": f"{_N} % 5 = 0", "known-section-opaque": f"{_N} % 6 = 0", "unsupported-inline-tags": f"{_N} % 7 = 0 OR {_N} % 13 = 0", "undefined-style": f"{_N} % 11 = 0", "unverified-version": f"{_N} % 17 = 0", "decode-selected": "true"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS code, '{'info' if c == 'decode-selected' else 'warning'}' AS severity, '{'none' if c == 'decode-selected' else 'semantic'}' AS lossiness, count(*) FILTER ({w})::BIGINT AS n FROM documents WHERE {_OK}" for c, w in _CODES.items()))
def diagnostic_counts(spark, d):
    return E.relation(_damaged(spark, d), "diagnostics").groupBy("code", "severity", "lossiness").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM documents WHERE {_OK} AND NOT ({' OR '.join('(' + w + ')' for c, w in _CODES.items() if c != 'decode-selected')})")
def strict_losses(spark, d):
    return E.strict(_damaged(spark, d))


@query(f"SELECT doc_id, CASE WHEN {_OK} THEN 'ok' ELSE 'error' END AS status, CASE WHEN {_N} % 19 = 0 THEN 'no-version-section' WHEN {_N} % 23 = 0 THEN 'no-style-section' END AS error FROM documents")
def malformed_documents(spark, d):
    return E.inspect(_damaged(spark, d)).select("doc_id", "status", "error")


@query(f"SELECT section, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter([CASE WHEN {_N} % 3 = 0 THEN 'strange' END, CASE WHEN {_N} % 4 = 0 THEN 'revisions' END, CASE WHEN {_N} % 6 = 0 THEN 'toc' END, CASE WHEN {_N} % 7 = 0 OR {_N} % 13 = 0 THEN 'edoc' END], lambda x: x IS NOT NULL)) AS section FROM documents WHERE {_OK}) GROUP BY 1")
def unknown_records(spark, d):
    return E.relation(_damaged(spark, d), "unknown_records").groupBy("section").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, (5 + ({_N} % 3 = 0)::INT + ({_N} % 4 = 0)::INT + ({_N} % 5 = 0)::INT + ({_N} % 6 = 0)::INT)::BIGINT AS n, list_sort(list_filter(['ver', 'sty', 'charset', 'tag', 'edoc', CASE WHEN {_N} % 3 = 0 THEN 'strange' END, CASE WHEN {_N} % 4 = 0 THEN 'revisions' END, CASE WHEN {_N} % 5 = 0 THEN 'macro' END, CASE WHEN {_N} % 6 = 0 THEN 'toc' END], lambda x: x IS NOT NULL)) AS names FROM documents WHERE {_OK}")
def section_table(spark, d):
    s = E.relation(_damaged(spark, d), "sections")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


@query(f"SELECT doc_id, list_sort(list_filter([CASE WHEN {_N} % 5 = 0 THEN 'active-section' END, CASE WHEN {_N} % 13 = 0 THEN 'dynamic-field' END], lambda x: x IS NOT NULL)) AS blocked FROM documents WHERE {_OK}")
def preflight(spark, d):
    """What keeps a document from being opened by the original program."""
    docs = _damaged(spark, d)
    return g.preflight(E.inspect(docs).where("status = 'ok'"), E.relation(docs, "unknown_records"), "doc_id")


_ENC = "CASE doc_id % 4 WHEN 0 THEN 'cp1252' WHEN 1 THEN CASE WHEN octet_length(encode(text)) > len(text) THEN 'utf-8' ELSE 'cp1252' END WHEN 2 THEN 'utf-16-le' ELSE 'utf-8' END"


@query(f"SELECT doc_id, {_ENC} AS encoding, md5({_JOINED}) AS text_md5 FROM documents")
def encoding_detect(spark, d):
    """Western bytes, UTF-8 without and with a mark, UTF-16 with one; no section names a code page."""
    x = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = F.concat(F.lit(f"[ver]{CRLF}\t4{CRLF}[sty]{CRLF}\t{CRLF}[edoc]{CRLF}"), F.replace(encode_escapes(F.col("text")), F.lit("\n"), F.lit(CRLF * 2)), F.lit(f"{CRLF}>{CRLF}"))
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.encode(whole, "ISO-8859-1")).when(k == 1, F.encode(whole, "UTF-8")).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(whole, "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode(whole, "UTF-8")))
    docs = x.select("doc_id", content.alias("content"))
    b = E.relation(docs, "blocks").groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n")).alias("text_md5"))
    return E.inspect(docs).select("doc_id", "encoding").join(b, "doc_id", "left").select("doc_id", "encoding", F.coalesce("text_md5", F.md5(F.lit(""))).alias("text_md5"))


# --- events as frames, nations as styles, parts as layouts, payloads -------------------------------------------


def _frames(spark, d) -> DataFrame:
    """A document per user: an event is a frame whose kind decides its place; the body has anchor 0 twice, every third
    anchor, and one beyond the last."""
    e = t(spark, d, "events")
    flags = F.when(F.col("event_type") == "view", "524288").when(F.col("event_type") == "click", "256").otherwise("0")
    f = lines("[frm]", "\t1", F.concat(F.lit("\t"), flags), "\t0", "\t0", F.concat(F.lit("\t"), (F.col("event_id") % 50).cast("string")), "\t100", "\t[txt]", F.concat(F.lit("e"), F.col("event_id").cast("string")), ">")
    rows = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", f.alias("f")))).alias("x"))
    marks = F.transform(F.expr("filter(sequence(0L, n), i -> i % 3 = 0 and i < n)"), lambda i: F.concat(F.lit("<:A"), i.cast("string"), F.lit(">")))
    body = F.concat(F.lit("a<:A0>b"), F.array_join(marks, ""), F.lit("<:A"), (F.col("n") + 2).cast("string"), F.lit(">"))
    return rows.select("user_id", to_bytes(document_text(body, F.array_join(F.transform("x", lambda r: r["f"]), ""))).alias("content"))


_F = """WITH f AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, CASE event_type WHEN 'view' THEN 'anchored' WHEN 'click' THEN 'repeating' ELSE 'fixed-page' END AS placement, event_id % 50 > 0 AS usable, CASE WHEN event_type = 'view' THEN count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 END AS anchor_no FROM events),
n AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n FROM events GROUP BY 1), u AS (SELECT user_id, unnest([0] || list_filter(range(0, n), lambda i: i % 3 = 0) || [n + 2]) AS a, generate_subscripts([0] || list_filter(range(0, n), lambda i: i % 3 = 0) || [n + 2], 1) - 1 AS pos, n FROM n) """


@query(_F + "SELECT user_id, frame_no::INT AS frame_no, placement, usable, anchor_no::INT AS anchor_no, 'e' || event_id AS text FROM f")
def frame_placement(spark, d):
    return E.relation(_frames(spark, d), "frames", "user_id").select("user_id", "frame_no", "placement", "usable", "anchor_no", "text")


@query(_F + "SELECT user_id, pos::INT AS pos, a::BIGINT AS anchor_no, CASE WHEN a >= n THEN 'out-of-range' WHEN a = 0 AND pos > 0 THEN 'duplicate' ELSE 'placed' END AS result FROM u")
def anchor_resolution(spark, d):
    return E.relation(_frames(spark, d), "anchors", "user_id").select("user_id", "pos", "anchor_no", "result")


@query(_F + "SELECT user_id, frame_no::INT AS frame_no FROM f WHERE anchor_no % 3 <> 0")
def unplaced_frames(spark, d):
    docs = _frames(spark, d)
    f, a = E.relation(docs, "frames", "user_id"), E.relation(docs, "anchors", "user_id")
    return f.where("anchor_no is not null").join(a.where("result = 'placed'").select("user_id", "anchor_no"), ["user_id", "anchor_no"], "left_anti").select("user_id", "frame_no")


def _styled(spark, d) -> DataFrame:
    """A document per region: its nations as styles, each defined twice, those with n_nationkey % 5 = 4 not at all; suppliers
    as paragraphs in the style of their nation."""
    n = t(spark, d, "nation")
    one = lambda k: tag(F.col("n_name"), F.col("n_nationkey") * 20 + 200 + k, F.col("n_nationkey") * 70000 + k, F.col("n_nationkey") % 4)
    styles = joined(n.where("n_nationkey % 5 <> 4"), "n_regionkey", ["n_nationkey"], F.concat(one(10), one(0)))
    s = t(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    body = joined(s, "n_regionkey", ["s_suppkey"], F.concat(F.lit("@"), F.col("n_name"), F.lit("@S"), F.col("s_suppkey").cast("string"), F.lit(CRLF * 2)))
    return body.join(styles.withColumnRenamed("pieces", "styles"), "n_regionkey").select("n_regionkey", to_bytes(document_text(F.col("pieces"), F.col("styles"))).alias("content"))


@query("""SELECT n_regionkey, n_name AS name, (n_nationkey * 20 + 200) / 20.0::DOUBLE AS size_pt, '#' || lower(lpad(to_hex(n_nationkey * 70000 & 255), 2, '0') || lpad(to_hex((n_nationkey * 70000 >> 8) & 255), 2, '0') || lpad(to_hex((n_nationkey * 70000 >> 16) & 255), 2, '0')) AS colour, n_nationkey & 1 = 1 AS bold, n_nationkey & 2 = 2 AS italic FROM nation WHERE n_nationkey % 5 <> 4 AND n_regionkey IN (SELECT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey)""")
def style_lookup_last_wins(spark, d):
    return E.relation(_styled(spark, d), "styles", "n_regionkey").where("name <> 'Body Text'").select("n_regionkey", "name", "size_pt", "colour", "bold", "italic")


@query("""SELECT n_regionkey, n_name AS style, 'S' || s_suppkey AS text, CASE WHEN n_nationkey % 5 <> 4 THEN (n_nationkey * 20 + 200) / 20.0 END::DOUBLE AS size_pt, n_nationkey % 5 <> 4 AS defined FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 5 <> 4)""")
def style_references(spark, d):
    docs = _styled(spark, d)
    r = E.style_lookup(E.relation(docs, "runs", "n_regionkey").select("n_regionkey", "style", "text"), E.relation(docs, "styles", "n_regionkey"), "n_regionkey")
    return r.select("n_regionkey", "style", "text", F.col("definition.size_pt").alias("size_pt"), F.col("definition").isNotNull().alias("defined"))


def _layouts(spark, d) -> DataFrame:
    p = t(spark, d, "part")
    s = lambda x: F.concat(F.lit("\t\t"), F.expr(x).cast("string"))
    side = lambda m, wide: lines(f"\t[{m}]", s("1000 + p_size * 600"), s(wide), "\t\t0", s("p_size * 60"), "\t\t720", s("p_partkey % 6"), "\t\t720", s("p_size * 50"), "\t\t0")
    lay = F.concat(lines("[lay]", F.concat(F.lit("\t"), F.col("p_name")), F.concat(F.lit("\t"), (F.col("p_partkey") * 131).cast("string"))), side("rght", "2000 + p_size * 500"), F.when(F.expr("p_partkey % 2 = 0"), side("lft", "9000")).otherwise(""))
    return p.select("p_partkey", to_bytes(document_text(F.lit("x"), lay)).alias("content"))


_LAY = "WITH g AS (SELECT *, p_partkey * 131 AS f, 1000 + p_size * 600 AS h, 2000 + p_size * 500 AS w FROM part), v AS (SELECT *, h BETWEEN 1440 AND 31680 AND w BETWEEN 1440 AND 31680 AND p_size * 60 < w AND p_size * 50 < w AND 720 < h AND w - p_size * 110 >= 720 AND h - 1440 >= 720 AS odd, CASE WHEN p_partkey % 2 = 0 THEN h BETWEEN 1440 AND 31680 AND p_size * 60 < 9000 AND 720 < h AND 9000 - p_size * 110 >= 720 AND h - 1440 >= 720 END AS even FROM g) "


@query(_LAY + "SELECT p_partkey, CASE f & 255 WHEN 1 THEN 'letter' WHEN 2 THEN 'legal' WHEN 3 THEN 'a3' WHEN 4 THEN 'a4' WHEN 5 THEN 'a5' WHEN 6 THEN 'b5' WHEN 7 THEN 'custom' ELSE 'unknown' END AS paper, CASE WHEN f & 256 <> 0 THEN 'landscape' ELSE 'portrait' END AS orientation, f & 512 <> 0 AS non_alternating, f & 1024 <> 0 AS mirrored, (f & ~8191)::BIGINT AS unknown_bits, odd OR coalesce(even, false) AS valid, odd AS odd_valid, even AS even_valid FROM v")
def page_layouts(spark, d):
    x = E.relation(_layouts(spark, d), "layouts", "p_partkey")
    return x.select("p_partkey", "paper", "orientation", "non_alternating", "mirrored", "unknown_bits", "valid", F.col("odd.valid").alias("odd_valid"), F.col("even.valid").alias("even_valid"))


@query(_LAY + "SELECT p_partkey, CASE WHEN odd THEN w ELSE 9000 END::BIGINT - p_size * 110 AS body_width FROM v WHERE odd OR even")
def body_widths(spark, d):
    return S.primary_width(E.relation(_layouts(spark, d), "layouts", "p_partkey"), "p_partkey")


_BMP = "424D3A000000000000003600000028000000010000000100000001001800000000000400000000000000000000000000000000000000"


def _payloads(spark, d) -> DataFrame:
    """A document per customer with a bitmap of one pixel after its body; every third directory row points beyond the file."""
    c = t(spark, d, "customer").select("c_custkey")
    text = to_bytes(document_text(F.lit("a<:A0>b"), lines("[frm]", "\t1", "\t524288", "\t0", "\t0", "\t90", "\t90", "\t[isd]", "\t\t.X1")))
    pixel = F.unhex(F.concat(F.lit(_BMP), F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"), F.lit("80FF00")))
    c = c.withColumn("head", text).withColumn("pixel", pixel)
    at = F.length("head") + F.when(F.col("c_custkey") % 3 == 0, 100000).otherwise(0)
    junk = F.when(F.col("c_custkey") % 5 == 0, "JUNK").otherwise("")
    directory = F.concat(junk, F.lit(CRLF), lines("[Embedded]", F.concat(F.lit("1 .bmp "), at.cast("string"), F.lit(" "), F.length("pixel").cast("string"), F.lit(" 0 0"))), F.lpad((F.length("head") + F.length("pixel") + F.length(junk) + 2).cast("string"), 8, "0"), F.lit(CRLF))
    return c.select("c_custkey", F.concat("head", "pixel", F.encode(directory, "ISO-8859-1")).alias("content"))


_PIX = f"unhex('{_BMP}' || lpad(to_hex(c_custkey % 256), 2, '0') || '80FF00')"


@query(f"SELECT c_custkey, '1' AS asset, '.bmp' AS ext, c_custkey % 3 <> 0 AS verified, CASE WHEN c_custkey % 3 <> 0 THEN sha256({_PIX}) END AS sha256, CASE WHEN c_custkey % 3 <> 0 THEN 'ok' ELSE 'unsupported' END AS status, 0::INT AS frame_no FROM customer")
def embedded_assets(spark, d):
    return E.relation(_payloads(spark, d), "assets", "c_custkey").select("c_custkey", "asset", "ext", "verified", "sha256", "status", "frame_no")


@query("SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 58 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 4 ELSE 0 END + 2)::BIGINT AS unindexed FROM customer")
def unindexed_bytes(spark, d):
    r = E.relation(_payloads(spark, d), "ranges", "c_custkey")
    return r.groupBy("c_custkey").agg(F.sum(F.when(F.col("kind") == "gap", F.col("hi") - F.col("lo")).otherwise(0)).alias("unindexed"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS shown, (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS lost FROM customer")
def image_html(spark, d):
    """Whether the bitmap is in the HTML, and whether the document lost content."""
    docs = _payloads(spark, d)
    o = E.renderer("html")(docs, "c_custkey").select("c_custkey", F.contains("output", F.lit('<img src="data:image/bmp;base64,')).alias("shown"))
    return o.join(E.inspect(docs, "c_custkey").select("c_custkey", F.coalesce(F.col("loss_counts")["content"] > 0, F.lit(False)).alias("lost")), "c_custkey")


@query("SELECT doc_id, b AS valid, false AS broken FROM (SELECT doc_id, (len(text) * 4 + 54) <= 10000000 AS b FROM documents)")
def bitmap_validation(spark, d):
    """A bitmap whose rows are the text's characters, whole and a byte short."""
    n = F.length("text")
    flip = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    x = t(spark, d, "documents").select("doc_id", F.greatest(n, F.lit(1)).cast("long").alias("n"))
    b = F.unhex(F.concat(F.lit("424D"), flip(F.col("n") * 4 + 54), F.lit("00000000" + "36000000" + "28000000" + "01000000"), flip(F.col("n")), F.lit("0100" + "1800" + "00000000" + "00" * 20), F.repeat(F.lit("0A0B0C00"), F.col("n").cast("int"))))
    ok = F.pandas_udf(legacy.bitmap, "boolean")
    y = x.select("doc_id", b.alias("b"))
    return y.select("doc_id", ok("b").alias("valid"), ok(F.expr("substring(b, 1, length(b) - 1)")).alias("broken"))


@query(f"SELECT doc_id, 'item-differs' AS issue, 0::BIGINT AS pos FROM documents WHERE len(string_split(text, chr(10))) >= 1 AND string_split(text, chr(10))[1] <> '' UNION ALL SELECT doc_id, 'count-mismatch', (len(string_split(text, chr(10))) - 1)::BIGINT FROM documents WHERE len(string_split(text, chr(10))) > 1")
def positional_compare(spark, d):
    e = t(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("items"))
    cut_one = F.when(F.size("items") > 1, F.slice("items", 1, F.size("items") - 1)).otherwise(F.col("items"))
    a = e.select("doc_id", F.transform(cut_one, lambda x, i: F.when(i == 0, F.lit("")).otherwise(x)).alias("items"))
    return g.positional_compare(e, a, "doc_id", "items")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'unsafe-escape' WHEN c_custkey % 4 = 2 THEN 'missing-eof' ELSE 'ok' END AS code, CASE WHEN c_custkey % 4 NOT IN (1, 2) THEN '07ff80' || lower(lpad(to_hex(c_custkey % 256), 2, '0')) || '0102' END AS rgb FROM customer")
def metafile_decode(spark, d):
    """A metafile of two 24-bit pixels per customer; some have an escape record, some no end."""
    from ..sources import payloads

    dib = F.concat(F.lit("28000000" + "02000000" + "01000000" + "0100" + "1800" + "00000000" * 4 + "00000000" * 2 + "80FF07" + "0201"), F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"), F.lit("0000"))
    blit = F.concat(F.lit("25000000" + "410B" + "2000CC00" + "0100" + "0200" + "0000" * 2 + "0100" + "0200" + "0000" * 2), dib)
    extra = F.when(F.col("c_custkey") % 4 == 1, "0400000026060000").otherwise("")
    end = F.when(F.col("c_custkey") % 4 == 2, "").otherwise("030000000000")
    body = F.concat(F.lit("05000000" + "0B02" + "00000000" + "05000000" + "0C02" + "0100" + "0200"), blit, extra, end)
    words = F.length(body) / 4 + 9
    le = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x.cast("int")), 8, "0"), k, 2) for k in (7, 5, 3, 1)])
    b = F.unhex(F.concat(F.lit("0100" + "0900" + "0003"), le(words), F.lit("0000" + "25000000" + "0000"), body))
    x = t(spark, d, "customer").select("c_custkey", payloads.read_metafile(b).alias("m"))
    return x.select("c_custkey", "m.code", F.lower(F.hex("m.rgb")).alias("rgb"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/bmp' END AS kind FROM customer")
def image_kinds(spark, d):
    from ..sources import payloads

    png = "89504E470D0A1A0A0000000D49484452000000010000000108060000001F15C4890000000A49444154789C6300010000050001" + "0D0A2DB4" + "0000000049454E44AE426082"
    gif = "474946383961010001008000000000000000002C00000000010001000002024401003B"
    jpeg = "FFD8" + "FFC0000B080001000101011100" + "FFDA0008010100003F00" + "7F" + "FFD9"
    k = F.col("c_custkey") % 5
    b = F.unhex(F.when(k == 0, png).when(k == 1, gif).when(k == 2, jpeg).when(k == 3, _BMP + "01020300").otherwise(F.concat(F.lit(png), F.lit("00"))))
    return t(spark, d, "customer").select("c_custkey", payloads.read_image_kind(b).alias("kind"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ['16-bit executable'] WHEN 1 THEN ['CAB archive', 'suffix .exe'] WHEN 2 THEN ['executable, second header out of range'] ELSE [] END AS findings FROM customer")
def file_findings(spark, d):
    from ..sources import payloads

    k = F.col("c_custkey") % 4
    mz = lambda at: "4D5A" + "00" * 58 + at
    b = F.unhex(F.when(k == 0, mz("40000000") + "4E450000").when(k == 1, "4D534346" + "00" * 60).when(k == 2, mz("FFFF0000")).otherwise("00" * 70))
    x = t(spark, d, "customer").select("c_custkey", b.alias("content"), F.concat("c_name", F.when(k == 1, ".EXE").otherwise(".bin")).alias("path"))
    return x.select("c_custkey", payloads.findings(F.col("content"), F.col("path")).alias("findings"))


@query("SELECT family, count(DISTINCT doc_id)::BIGINT AS documents, list_sort(list(DISTINCT source)) AS sources FROM (SELECT doc_id, 'arial' AS family, unnest(['style', 'run']) AS source FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 'arial', 'style' FROM documents UNION ALL SELECT doc_id, 'courier', 'run' FROM (SELECT doc_id, max(len(list_filter(string_split(line, ' '), lambda x: x <> ''))) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1) WHERE n >= 6) GROUP BY 1")
def requested_fonts(spark, d):
    """Font families that styles and runs ask for, by their normalised name."""
    from ..functions.scalars import fold_family

    f = E.relation(_marked(spark, d), "fonts")
    return f.groupBy(fold_family(F.col("family")).alias("family")).agg(F.countDistinct("doc_id").alias("documents"), F.array_sort(F.collect_set("source")).alias("sources"))


def _furnished(spark, d) -> DataFrame:
    """A document per part: a page layout with a header for odd pages, and one for even pages whose p_size lines decide whether
    it fits; every fourth part has two of them."""
    p = t(spark, d, "part")
    side = lines("\t[rght]", *[f"\t\t{x}" for x in (15840, 12240, 0, 1440, 1440, 1, 1440, 1440, 0)])
    head = lambda m, text: F.concat(lines(f"\t[{m}]", "\t\t[lyfrm]", "\t\t\t1", "\t\t\t2048", "\t\t\t0", "\t\t\t0", "\t\t\t900", "\t\t\t900", "\t\t[txt]"), text, lines("", ">"))
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda k: F.concat(F.lit("l"), k.cast("string"))), CRLF * 2)
    lay = F.concat(lines("[lay]", "\tMain", "\t1"), side, head("hrght", F.lit("top")), head("hlft", many), F.when(F.expr("p_partkey % 4 = 0"), head("hlft", F.lit("again"))).otherwise(""))
    return p.select("p_partkey", to_bytes(document_text(F.lit("x"), lay)).alias("content"))


@query("SELECT p_partkey, unnest(list_filter(['odd', CASE WHEN p_partkey % 4 <> 0 AND p_size * 9 <= 68 THEN 'even' END], lambda x: x IS NOT NULL)) AS slot FROM part")
def promoted_furniture(spark, d):
    docs = _furnished(spark, d)
    return E.relation(docs, "promoted", "p_partkey").select("p_partkey", F.explode("slots").alias("slot"))


@query(f"SELECT doc_id, CASE WHEN {_OK} THEN 'ok' ELSE doc_id || ': ERROR ' || CASE WHEN {_N} % 19 = 0 THEN 'no-version-section' ELSE 'no-style-section' END END AS report FROM documents")
def inspection_report(spark, d):
    r = E.inspection_report(E.inspect(_damaged(spark, d)))
    return r.select("doc_id", F.when(F.col("report").rlike(r"^\d+: version [49] cp1252, \d+ text characters, 1 styles, lossy=(?:true|false)\n  blocks: "), "ok").otherwise(F.col("report")).alias("report"))


@query(f"SELECT doc_id, octet_length(encode({_JOINED}))::BIGINT + CASE WHEN len({_P}) > 0 THEN len({_P}) ELSE 0 END AS bytes FROM documents")
def write_files(spark, d):
    """The text output, a file a document, in the shared folder; blank lines between paragraphs and a last break add a byte each."""
    import os
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="palimpsest-")
    folder = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"files-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return E.write_files(E.renderer("text")(corpus(spark, d)), folder, ".txt").select("doc_id", "bytes")


@query("SELECT page_id, 'ltr' AS direction, md5(html) AS clean FROM pages WHERE html IS NOT NULL AND false UNION ALL SELECT page_id, 'ltr', md5(substr(html, 1, 200)) FROM pages")
def clean_text(spark, d):
    from ..functions.scalars import direction, sanitize

    h = F.substring("html", 1, 200)
    return t(spark, d, "pages").select("page_id", direction(h).alias("direction"), F.md5(sanitize(h)).alias("clean"))
