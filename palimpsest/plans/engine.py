"""The document engine on DataFrames. Documents are parsed inside Arrow batches, a document at a time and in one linear pass;
every relation and every output format is one narrow mapInArrow, so parsing and rendering a corpus shuffle nothing. What relates
rows to each other (joins, windows, aggregates) is plain DataFrame code in the other modules of this package.

A document that can't be parsed is a row with status 'error' and a code, in `documents` and in every rendering; the
other relations have no rows of it."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from ..parsing import packages, quick, render
from ..parsing.document import parse
from ..parsing.envelope import Limits, Rejected
from ..parsing.inline import Char
from ..parsing.model import Block, Document, structure_known
from ..parsing.records import CELL, material

SLICE = 64


def _walk(blocks: list[Block], path: tuple = ()):
    for n, b in enumerate(blocks):
        node = (*path, n)
        yield node, b
        yield from _walk(b.children, node)


def _documents(doc: Document):
    kinds = Counter(b.kind for _, b in _walk(doc.blocks))
    diag = doc.diagnostics
    lost = Counter(d[2] for d in diag if d[2] != "none")
    text = render.document_text(doc.blocks)
    maps = [sorted(Counter(x).items()) for x in (kinds.elements(), (s.key for s in doc.sections), (d[1] for d in diag), (d[0] for d in diag), lost.elements())]
    yield ("ok", None, None, doc.encoding, doc.version, doc.newline, doc.size, len(text), len(doc.styles), len(doc.sections), len(doc.unknown), doc.lossy, *maps, doc.l1, sorted(doc.metadata.items()))


def _lines(doc: Document):
    src, at, names = doc.source, 0, {}
    for no, s in enumerate(doc.sections):
        names[s.line] = no
    current = None
    for k, (x, a) in enumerate(zip(src.lines, src.starts)):
        current = names.get(k, current)
        yield k, x, a, src.starts[k + 1] if k + 1 < len(src.starts) else None, current


def _sections(doc: Document):
    seen: Counter = Counter()
    for no, s in enumerate(doc.sections):
        seen[s.key] += 1
        yield no, s.name, seen[s.key], s.line, len(s.lines)


def _blocks(doc: Document):
    for node, b in _walk(doc.blocks):
        r = b.region or (None, None)
        text = b.text if b.kind == "paragraph" else render.document_text([b]) if not b.children else None
        yield list(node), list(node[:-1]), len(node) - 1, node[-1], b.kind, b.line, text, b.style, b.alignment, b.list_kind, bool(b.page_break), r[0], r[1], b.indents, b.spacing, b.placement, b.terminated, b.flags, b.metadata, b.object, b.origin, b.layout, b.kind in ("frame", "header", "footer") and structure_known(b)


def _runs(doc: Document):
    for node, b in _walk(doc.blocks):
        for k, (t, c) in enumerate(b.runs):
            yield list(node), k, b.style, t, *c


def _styles(doc: Document):
    for s in doc.styles.values():
        yield s.ordinal, s.name, *s.char, s.alignment, s.spacing, s.left, s.first, s.before, s.after, s.shortcut, s.following


def _layouts(doc: Document):
    for x in doc.layouts:
        yield x["index"], x["name"], x["flags"], x["paper"], x["orientation"], x["non_alternating"], x["mirrored"], x["second_header"], x["second_footer"], x["unknown_bits"], x["valid"], *({k: g.get(k) for k in _SIDE} if g else None for g in (x["odd"], x["even"]))


def _frames(doc: Document):
    for f in doc.frames:
        b = f.bounds or [None] * 4
        yield f.number, f.line, f.name, f.content, f.placement, f.region, f.page, f.flags, f.unknown_bits, *b, bool(f.usable), f.opaque, f.wrap, f.anchor, bool(f.is_table), render.document_text(f.children)


def _tables(doc: Document):
    for k, t in enumerate(doc.tables):
        yield k, t["frame"], t["line"], *(t["definition"] or [None] * 9), t["formulas"], len(t["cells"]), *(t["bounds"] + [None] * 4)[:4]


def _metrics(doc: Document):
    for k, t in enumerate(doc.tables):
        for n, (family, _, v, accepted) in enumerate(t["shapes"]):
            if v and family in ("h", "w"):
                yield k, n, {"h": "row", "w": "column"}[family], *v[:4], list(v[4:]), accepted


def _cells(doc: Document):
    for k, t in enumerate(doc.tables):
        for c in t["cells"]:
            yield k, c["ordinal"], *c["place"], c["fields"], *c.get("span", (1, 1)), c.get("covered", False), c["raw_empty"], c["material"], c["alignments"], c["after"], c["text"]


def _shapes(doc: Document):
    for k, t in enumerate(doc.tables):
        for family, arity, v, _ in t["shapes"]:
            yield k, family, arity, v is not None


def _grids(doc: Document):
    """statistics.grid_report, a table at a time."""
    for k, t in enumerate(doc.tables):
        rows, cols = t["definition"][:2] if t["definition"] else (None, None)
        places = [c["place"] for c in t["cells"]]
        kinds, inside, swapped, top, low = set(places), 0, 0, (None, None), (None, None)
        if places:
            r, c = [p[0] for p in places], [p[1] for p in places]
            top, low = (max(r), max(c)), (min(r), min(c))
            if rows is not None:
                inside = len(places) if top[0] < rows and top[1] < cols else sum(a < rows and b < cols for a, b in places)
                swapped = sum(a < cols and b < rows for a, b in places)
        capacity = None if rows is None else rows * cols
        yield k, rows, cols, capacity, len(places), len(kinds), inside, swapped, *top, *low, bool(places) and capacity is not None and len(kinds) == capacity and inside == len(places)


def _indexes(doc: Document):
    """What statistics.index_report sums up, for each table's row and column metrics."""
    for k, t in enumerate(doc.tables):
        d = t["definition"]
        for family, name, own, other in (("h", "row", 0, 1), ("w", "column", 1, 0)):
            v = [x for f, _, x, _ in t["shapes"] if f == family and x]
            if not v:
                continue
            index = [x[0] for x in v]
            facts = [d[own], d[other]] + [len(set(index)), max(index), *(sum(i < most for i in index) for most in (d[own], d[other])), sum(x[1] == d[2 + 2 * own] for x in v), sum(x[2] == d[3 + 2 * own] for x in v)] if d else [None, None, len(set(index)), max(index), 0, 0, 0, 0]
            yield k, name, len(v), *facts


def _extents(doc: Document):
    """statistics.extents, a table at a time."""
    for k, t in enumerate(doc.tables):
        if not (d := t["definition"]):
            continue
        size = []
        for family, n in (("h", 0), ("w", 1)):
            own = {v[0]: v[1] + v[2] for f, _, v, _ in t["shapes"] if f == family and v and v[0] < d[n]}  # the last holds
            size.append(sum(own.values()) + (d[n] - len(own)) * (d[2 + 2 * n] + d[3 + 2 * n]))
        left, top, right, bottom = (t["bounds"] + [None] * 4)[:4]
        yield k, *size, None if None in (top, bottom) else bottom - top, None if None in (left, right) else right - left, d[7], d[8]


def _assets(doc: Document):
    for a in doc.assets:
        yield a["id"], a["ext"], a["at"], a["size"], a["verified"], a["sha256"], a["status"], a["frame"]


def _ranges(doc: Document):
    for name, spans in (("payload", doc.source.spans), ("gap", doc.source.gaps)):
        for a, b in spans:
            yield name, a, b


_COMMAND = re.compile(r"<(?:(:#)(-?\d{1,20}),(-?\d{1,20})|(:I)(\d{1,9}),(\d{1,9}),(\d{1,9}),(\d{1,9})|(:f)(-?\d{1,9})(?:,[^>]*)?)>")
_BLANK = re.compile(r"\n(?:[ \t]*\n)+")


def _commands(doc: Document):
    """Region, indent and font-size commands of the body, each with the blank-delimited unit that holds it."""
    body = next((s for s in doc.sections if s.key == "edoc"), None)
    text = "\n".join(body.lines) if body else ""
    if "<:" not in text:
        return
    blanks = [m.span() for m in _BLANK.finditer(text)]
    los, his = [0, *(b for _, b in blanks)], [*(a for a, _ in blanks), len(text)]
    unit, chars = 0, None
    for m in _COMMAND.finditer(text):
        while unit + 1 < len(los) and los[unit + 1] <= m.start():
            unit, chars = unit + 1, None
        if chars is None:
            chars = material(text[los[unit] : his[unit]])
        values = m.groups()[1:3] if m[1] else m.groups()[4:8] if m[4] else m.groups()[9:10]
        yield m.start(), m.end(), (m[1] or m[4] or m[9])[1:], [min(int(v), 2**62) for v in values], unit, los[unit], his[unit], chars, not material(text[los[unit] : m.start()])


def _fonts(doc: Document):
    """Each family once that styles or runs ask for: runs are many, and their families few."""
    yield from dict.fromkeys(("style", s.char.family) for s in doc.styles.values() if s.char.family)
    yield from dict.fromkeys(("run", c.family) for _, b in _walk(doc.blocks) for _, c in b.runs if c.family)


def _side(layout: dict) -> dict | None:
    """The geometry of a layout's pages: of the odd side, else of the even."""
    return next((g for g in (layout["odd"], layout["even"]) if g and g["valid"]), None)


def _regions(doc: Document):
    """statistics.region_observations, a document at a time."""
    rows = list(_commands(doc))
    page = next((g for x in doc.layouts if (g := _side(x))), None)
    body = page["width"] - page["left"] - page["right"] if page else None
    out, size, unit = [], None, None
    for _, _, kind, values, n, _, _, chars, _ in reversed(rows):
        if n != unit:
            unit, size = n, None
        if kind == "f":
            size = values[0]
        elif kind == "#" and values[0] >= 0 and values[1] >= 0:
            out.append((values[0], values[1], body, size, chars))
    yield from reversed(out)


def _promoted(doc: Document):
    """What promoted gives, a document at a time."""
    layout, g = next(((x, g) for x in doc.layouts if (g := _side(x))), (None, None))
    if not layout:
        return
    found, taken = [], Counter()
    for n, b in enumerate(doc.blocks):
        if b.origin != "layout" or b.kind not in ("header", "footer") or b.layout != layout["index"]:
            continue
        both = b.placement in ("all", "odd-even") or (layout["non_alternating"] and b.placement == "odd")
        slots = ["even", "odd"] if both else [b.placement] if b.placement in ("odd", "even") and not layout["non_alternating"] else []
        if slots:
            found.append((n, b, slots))
            taken.update((b.kind, s) for s in slots)
    width = (g["width"] - g["left"] - g["right"]) / 20.0
    for n, b, slots in found:
        if not (b.children and b.terminated and structure_known(b) and all(taken[b.kind, s] == 1 for s in slots) and all(c.kind == "paragraph" for c in b.children)):
            continue
        lines = len(b.children) * math.ceil(max(1.0, max(len(c.text) for c in b.children) * 4.4 / max(36.0, width)))
        margin = (g["top"] if b.kind == "header" else g["bottom"]) / 20.0
        if lines <= 64 and margin >= 13 and lines * 9 <= margin - 4:
            yield [n], b.kind, slots


_SIDE = ("height", "width", "reserved", "left", "bottom", "unit", "top", "right", "flags", "valid", "fields")
_SIDE_DDL = "struct<" + ",".join(f"{k}:{'boolean' if k == 'valid' else 'int' if k == 'fields' else 'bigint'}" for k in _SIDE) + ">"
_CHAR_DDL = "bold boolean, italic boolean, underline boolean, strike boolean, superscript boolean, subscript boolean, family string, size_pt double, colour string"
_COUNTS = "map<string,bigint>"
#: relation -> (rows of a document, columns after the key)
RELATIONS = {
    "documents": (_documents, f"status string, error string, detail string, encoding string, version string, newline string, bytes long, text_chars long, styles long, sections long, unknown_records long, lossy boolean, block_counts {_COUNTS}, section_counts {_COUNTS}, diagnostic_counts {_COUNTS}, severity_counts {_COUNTS}, loss_counts {_COUNTS}, l1 long, metadata map<string,string>"),
    "lines": (_lines, "line_no int, text string, first_byte long, end_byte long, sec_no int"),
    "sections": (_sections, "sec_no int, name string, ordinal int, first_line int, n_lines int"),
    "blocks": (_blocks, "node array<int>, parent array<int>, depth int, ordinal int, kind string, line int, text string, style string, alignment string, list_kind string, page_break boolean, region_x long, region_width long, indents array<bigint>, spacing double, placement string, terminated boolean, flags decimal(38,0), metadata string, object string, origin string, layout_index int, structure_known boolean"),
    "runs": (_runs, f"node array<int>, run_no int, style string, text string, {_CHAR_DDL}"),
    "diagnostics": (lambda d: ((k, *x) for k, x in enumerate(d.diagnostics)), "seq int, severity string, code string, lossiness string, line int, raw string"),
    "unknown_records": (lambda d: ((k, *x) for k, x in enumerate(d.unknown)), "seq int, section string, type string, raw string, line int"),
    "styles": (_styles, f"style_no int, name string, {_CHAR_DDL}, alignment string, spacing double, left_in double, first_line_in double, before_pt double, after_pt double, shortcut long, following string"),
    "layouts": (_layouts, f"layout_index int, name string, flags long, paper string, orientation string, non_alternating boolean, mirrored boolean, second_header boolean, second_footer boolean, unknown_bits long, valid boolean, odd {_SIDE_DDL}, even {_SIDE_DDL}"),
    "frames": (_frames, "frame_no int, line int, name string, content string, placement string, region string, page decimal(38,0), flags long, unknown_bits long, left decimal(38,0), top decimal(38,0), right decimal(38,0), bottom decimal(38,0), usable boolean, opaque boolean, wrap boolean, anchor_no int, is_table boolean, text string"),
    "anchors": (lambda d: ((k, *x) for k, x in enumerate(d.anchors)), "pos int, kind string, anchor_no long, line int, result string"),
    "tables": (_tables, "table_no int, frame_no int, line int, rows int, cols int, row_height int, row_gutter int, col_width int, col_gutter int, flags long, tail_1 long, tail_2 long, formulas int, cell_records int, left long, top long, right long, bottom long"),
    "metrics": (_metrics, "table_no int, record_no int, family string, index long, extent long, gutter long, flags long, reserved array<bigint>, accepted boolean"),
    "cells": (_cells, "table_no int, ordinal int, row long, col long, fields array<bigint>, row_span int, col_span int, covered boolean, raw_empty boolean, material int, alignments array<string>, lines_after int, text string"),
    "shapes": (_shapes, "table_no int, family string, arity int, canonical boolean"),
    "grids": (_grids, "table_no int, rows int, cols int, capacity long, cells long, places long, inside long, inside_swapped long, top_row long, top_col long, low_row long, low_col long, complete boolean"),
    "indexes": (_indexes, "table_no int, family string, n long, own int, other int, distinct long, top long, inside long, inside_other long, default_extent long, default_gutter long"),
    "extents": (_extents, "table_no int, height long, width long, outer_height long, outer_width long, tail_1 long, tail_2 long"),
    "assets": (_assets, "asset string, ext string, at long, size long, verified boolean, sha256 string, status string, frame_no int"),
    "ranges": (_ranges, "kind string, lo long, hi long"),
    "commands": (_commands, "at int, end_at int, kind string, values array<bigint>, unit int, unit_lo int, unit_hi int, material int, before_material boolean"),
    "regions": (_regions, "first long, width long, body_width long, font_size long, material int"),
    "promoted": (_promoted, "node array<int>, kind string, slots array<string>"),
    "fonts": (_fonts, "source string, family string"),
    "footnote_options": (lambda d: [tuple(d.footnotes.values())] if d.footnotes else [], "page_end boolean, reset boolean, line boolean, start int, separator_in double, indent_in double, unknown_bits int"),
}
#: Relations of nothing but the tables, which documents of a plain form give without a whole parse.
TABULAR = frozenset(("tables", "metrics", "cells", "shapes", "grids", "indexes", "extents"))
_FAILED = len(RELATIONS["documents"][1].split(", ")) - 3


def _run(docs: DataFrame, key: str, ddl: str, each) -> DataFrame:
    """One pass of each(content, ...) -> rows over the documents, SLICE at a time so that a batch holds few of them."""
    kind = docs.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"`{key}` {kind}, {ddl}")
    arrow = to_arrow_schema(schema)
    n = len(arrow)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                index, columns = [], [[] for _ in range(n - 1)]
                for k, content in enumerate(b.column(1).to_pylist()):
                    for row in each(content):
                        index.append(k)
                        for c, v in zip(columns, row):
                            c.append(v)
                keys = b.column(0).take(pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys.cast(arrow.field(0).type), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns))], schema=arrow)

    small_batches(docs.sparkSession)
    return spread(docs.select(key, "content"), key).mapInArrow(run, schema)


def small_batches(spark) -> None:
    """A worker holds one Arrow batch of documents, whose size must not follow the input: batches end at 4 MB or 2,048 rows,
    unless the session says less."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= 2048:
        spark.conf.set(rows, "2048")
    spark.conf.set(size, "4194304")


def together(docs: DataFrame, names: tuple[str, ...], key: str = "doc_id") -> dict[str, DataFrame]:
    """Several relations of one pass: a row a document with an array of rows for each, stored where the session has a
    checkpoint folder, so that no document is parsed once a relation."""
    ddl = ", ".join(f"`{n}` array<struct<{_as_struct(RELATIONS[n][1])}>>" for n in names)
    schema = StructType.fromDDL(f"`{key}` {docs.schema[key].dataType.simpleString()}, {ddl}")
    arrow = to_arrow_schema(schema)
    tabular = TABULAR.issuperset(names)

    def rows(content) -> list[list]:
        try:
            doc = (quick.tables(content) if tabular else None) or parse(content)
        except Rejected:
            return [[] for _ in names]
        return [list(RELATIONS[n][0](doc)) for n in names]

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                found = [rows(bytes(c)) if c is not None else [[] for _ in names] for c in b.column(1).to_pylist()]
                out = [b.column(0).cast(arrow.field(0).type)]
                for k in range(len(names)):
                    kind = arrow.field(k + 1).type
                    flat = [r for f in found for r in f[k]]
                    columns = [pa.array([r[i] for r in flat], kind.value_type.field(i).type) for i in range(kind.value_type.num_fields)]
                    offsets = [0]
                    for f in found:
                        offsets.append(offsets[-1] + len(f[k]))
                    out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind))
                yield pa.RecordBatch.from_arrays(out, schema=arrow)

    small_batches(docs.sparkSession)
    whole = stored(spread(docs.select(key, "content"), key).mapInArrow(run, schema))
    return {n: whole.select(key, F.inline(n)) for n in names}


def _as_struct(ddl: str) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def spread(docs: DataFrame, key: str) -> DataFrame:
    """Where a plain scan is so small that it would leave cores idle (as a file of one row group does), rows are dealt out
    before they are parsed: parsing is what costs. Anything larger, or already shuffled, stays as it is."""
    spark, plan = docs.sparkSession, docs._jdf.queryExecution()
    cores = spark.sparkContext.defaultParallelism
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if "Exchange" in plan.executedPlan().toString() or int(str(plan.optimizedPlan().stats().sizeInBytes())) >= cores * int(least):
        return docs
    return docs.repartition(2 * cores, key)


def relation(docs: DataFrame, name: str, key: str = "doc_id", encoding: str | None = None, **limits: int) -> DataFrame:
    """A relation of the documents: docs has the key and content. encoding overrides the code page; limits lower ceilings."""
    fn, ddl = RELATIONS[name]
    lim = Limits().lowered(**limits)
    errors = name == "documents"
    plain = name in TABULAR and lim == Limits() and encoding is None

    def each(content):
        if content is None:
            if errors:
                yield ("error", "unreadable", None, *[None] * _FAILED)
            return
        if plain and (doc := quick.tables(bytes(content))):
            yield from fn(doc)
            return
        try:
            doc = parse(bytes(content), lim, encoding)
        except Rejected as e:
            if errors:
                yield ("error", e.code, str(e), None, None, None, len(content), *[None] * (_FAILED - 4))
            return
        yield from fn(doc)

    return _run(docs, key, ddl, each)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the session's checkpoint folder, where it has one, for a relation that several plans read."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def inspect(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """A row per document: status, sizes, counts by kind of block, section, diagnostic, severity and loss."""
    return relation(docs, "documents", key, **options)


def summary(inspected: DataFrame) -> DataFrame:
    """One row over all documents; the counters are summed key by key, so their size is that of the vocabulary."""
    total = inspected.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "ok").alias("successful"), F.count_if(F.col("status") != "ok").alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("text_chars"), F.lit(0)).alias("text_chars"), F.count_if("lossy").alias("lossy_files"))
    names = ("block_counts", "section_counts", "diagnostic_counts", "severity_counts", "loss_counts")
    each = inspected.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("m")) for n in names])).alias("x")).select("x.counter", F.explode("x.m").alias("name", "n"))
    sums = each.groupBy("counter", "name").agg(F.sum("n").alias("n")).groupBy("counter").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("m"))
    maps = sums.agg(*[F.first(F.when(F.col("counter") == n, F.col("m")), ignorenulls=True).alias(n) for n in names])
    return total.crossJoin(F.broadcast(maps))  # one row each


def failures(inspected: DataFrame, key: str = "doc_id") -> DataFrame:
    return inspected.where("status <> 'ok'").select(key, "error", "detail")


def strict(docs: DataFrame, key: str = "doc_id", losses: tuple = ("semantic", "content"), **options) -> DataFrame:
    """The documents that parse without a loss of these kinds."""
    ok = inspect(docs, key, **options).where("status = 'ok'")
    for kind in losses:
        ok = ok.where(F.coalesce(F.col("loss_counts")[kind], F.lit(0)) == 0)
    return ok.select(key)


FORMATS = {
    "text": ("string", lambda d, labels: render.Text(d, labels).render()),
    "markdown": ("string", lambda d, labels: render.Markdown(d, labels).render()),
    "html": ("string", lambda d, labels: render.Html(d, labels).render()),
    "json": ("string", lambda d, labels: render.render_json(d)),
    "odt": ("binary", packages.odt),
    "docx": ("binary", packages.docx),
    "pdf": ("binary", packages.pdf),
}
ALIASES = {"txt": "text", "md": "markdown", "htm": "html", "plain": "text"}


def renderer(name: str):
    """The function docs -> (key, output, error) of a format, by name or alias."""
    known = ALIASES.get(name.lower(), name.lower())
    if known not in FORMATS:
        raise ValueError(f"unknown format {name!r}; there are {', '.join(sorted(FORMATS))}")
    kind, write = FORMATS[known]

    def run(docs: DataFrame, key: str = "doc_id", labels: bool = False, encoding: str | None = None, **limits: int) -> DataFrame:
        lim = Limits().lowered(**limits)

        def each(content):
            if content is None:
                yield None, "unreadable"
                return
            try:
                doc = parse(bytes(content), lim, encoding)
            except Rejected as e:
                yield None, e.code
                return
            yield write(doc, labels), None

        return _run(docs, key, f"output {kind}, error string", each)

    return run


def write_files(rendered: DataFrame, folder: str, suffix: str, key: str = "doc_id") -> DataFrame:
    """One file a document in a folder that all executors share, each written beside its place and then moved there, so a file
    is whole or absent and a task that runs again only replaces it. Returns key, path, bytes; nothing is written before an
    action needs them. Names are the keys with what isn't a letter, digit, dot or dash as an underscore, and a digest."""
    kind = rendered.schema[key].dataType.simpleString()

    def run(batches):
        import hashlib
        import os

        for b in batches:
            paths, sizes = [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = v.encode() if isinstance(v, str) else v or b""
                name = re.sub(r"[^A-Za-z0-9.-]+", "_", str(k))[-80:] + "-" + hashlib.sha256(str(k).encode()).hexdigest()[:12] + suffix
                path = os.path.join(folder, name)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(part, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths), pa.array(sizes, pa.int64())], [key, "path", "bytes"])

    return rendered.where("error is null").select(key, "output").mapInArrow(run, f"`{key}` {kind}, path string, bytes long")


def inspection_report(inspected: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, report: what inspection found, as lines to read."""
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ", ")
    k = F.col(key).cast("string")
    ok = F.concat(k, F.lit(": version "), F.col("version"), F.lit(" "), F.col("encoding"), F.lit(", "), F.col("text_chars").cast("string"), F.lit(" text characters, "), F.col("styles").cast("string"), F.lit(" styles, lossy="), F.col("lossy").cast("string"), *[F.concat(F.lit(f"\n  {n}: "), pairs(F.col(c))) for n, c in (("blocks", "block_counts"), ("sections", "section_counts"))], *[F.when(F.size(c) > 0, F.concat(F.lit(f"\n  {n}: "), pairs(F.col(c)))).otherwise("") for n, c in (("diagnostics", "diagnostic_counts"), ("losses", "loss_counts"))])
    return inspected.select(key, F.when(F.col("status") == "ok", ok).otherwise(F.concat(k, F.lit(": ERROR "), F.col("error"))).alias("report"))


def promoted(blocks: DataFrame, layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, node, kind, slot: headers and footers of the first usable page layout that can repeat on its pages: closed and
    understood, alone in their slot (odd or even pages), and low enough for the margin (9 points a line, 4 to spare)."""
    side = lambda g: F.when(F.col(g)["valid"], F.col(g))
    page = layouts.withColumn("_g", F.coalesce(side("odd"), side("even"))).where("_g is not null").groupBy(key).agg(F.min_by(F.struct("layout_index", "non_alternating", "_g"), "layout_index").alias("_p"))
    inner = blocks.where("depth = 1").groupBy(key, F.col("parent")[0].alias("ordinal")).agg(F.count("*").alias("_lines"), F.max(F.length("text")).alias("_longest"), F.max(F.col("kind") != "paragraph").alias("_other"))
    f = blocks.where("depth = 0 and origin = 'layout' and kind in ('header', 'footer')").join(page, key).where("layout_index = _p.layout_index").join(inner, [key, "ordinal"], "left")
    slots = F.when(F.col("_p.non_alternating"), F.when(F.col("placement").isin("all", "odd", "odd-even"), F.array(F.lit("odd"), F.lit("even")))).when(F.col("placement").isin("all", "odd-even"), F.array(F.lit("odd"), F.lit("even"))).when(F.col("placement").isin("odd", "even"), F.array("placement"))
    f = f.withColumn("slot", F.explode(slots)).withColumn("_alone", F.count("*").over(Window.partitionBy(key, "kind", "slot")) == 1)
    g = F.col("_p._g")
    width = (g["width"] - g["left"] - g["right"]) / 20.0  # points; 8-point text is about 4.4 points a character
    lines = F.col("_lines") * F.ceil(F.greatest(F.lit(1.0), F.col("_longest") * 4.4 / F.greatest(F.lit(36.0), width)))
    margin = F.when(F.col("kind") == "header", g["top"]).otherwise(g["bottom"]) / 20.0
    fits = (lines <= 64) & (margin >= 13) & (lines * 9 <= margin - 4) & ~F.col("_other")
    good = f.withColumn("_ok", F.col("_alone") & F.col("terminated") & F.col("structure_known") & F.coalesce(fits, F.lit(False)))
    every = good.groupBy(key, "node", "kind").agg(F.min("_ok").alias("_ok"), F.array_sort(F.collect_list("slot")).alias("slots"))
    return every.where("_ok").select(key, "node", "kind", "slots")


def style_lookup(runs: DataFrame, styles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs with the definition of their style: by exact name, else the first that is the same but for case. The styles of
    one document are few, and both sides are keyed by document."""
    by_case = styles.groupBy(key, F.lower("name").alias("_folded")).agg(F.min_by(F.struct("name", "size_pt", "alignment"), "style_no").alias("_any"))
    exact = styles.select(key, F.col("name").alias("style"), F.struct("name", "size_pt", "alignment").alias("_own"))
    j = runs.join(exact, [key, "style"], "left").withColumn("_folded", F.lower("style")).join(by_case, [key, "_folded"], "left")
    return j.select(*runs.columns, F.coalesce("_own", "_any").alias("definition"))


__all__ = ["CELL", "Char", "FORMATS", "RELATIONS", "failures", "inspect", "relation", "renderer", "strict", "style_lookup", "summary"]
