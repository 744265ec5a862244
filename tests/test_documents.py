"""The parser, the renderers and the scan on small invented documents."""

import io
import random
import xml.dom.minidom
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import generic as g
from palimpsest.parsing import envelope, inline, packages, render
from palimpsest.parsing.document import parse
from palimpsest.parsing.envelope import Limits, Rejected
from palimpsest.parsing.model import loss
from palimpsest.plans import engine as E
from palimpsest.sources import legacy

STYLE = "[tag]\n\tBody Text\n\t2\n\t[fnt]\n\t\tArial\n\t\t240\n\t\t0\n\t\t0\n\tBody Text\n\t0\n\t0\n"


def doc(body, head="", close=">\n", styles=STYLE, version="4"):
    return f"[ver]\n\t{version}\n[sty]\n\t\n{styles}{head}[edoc]\n{body}\n{close}".replace("\n", "\r\n").encode("cp1252")


def codes(d):
    return [x[1] for x in d.diagnostics if x[1] != "decode-selected"]


def kinds(blocks):
    return [(b.kind, b.text or b.object) for b in blocks]


# --- rejects, limits, code pages -----------------------------------------------------------------------------


def test_rejected_documents_are_rows(spark):
    rows = [b"", None, b"nothing here", b"[ver]\r\n", b"[ver]\r\n\t4\r\n", b" " * 5000 + b"\r\n[ver]\r\n\t4\r\n[sty]\r\n", doc("a")]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, content binary")
    got = {r.doc_id: (r.status, r.error) for r in E.inspect(d).collect()}
    assert got == {0: ("error", "empty"), 1: ("error", "unreadable"), 2: ("error", "no-version-section"), 3: ("error", "no-version"), 4: ("error", "no-style-section"), 5: ("error", "no-version-section"), 6: ("ok", None)}
    assert {r.doc_id: r.error for r in E.renderer("text")(d).collect()}[0] == "empty"
    assert E.relation(d, "blocks").count() == 1 and E.failures(E.inspect(d)).count() == 6
    assert E.inspect(d.limit(0)).count() == 0


def test_limits_only_go_down():
    with pytest.raises(Rejected, match="file bytes"):
        parse(doc("a"), Limits().lowered(file_bytes=10))
    with pytest.raises(Rejected, match="lines"):
        parse(doc("a\n" * 50), Limits().lowered(lines=40))
    with pytest.raises(Rejected, match="container depth"):
        parse(doc("<:N1\n" * 5), Limits().lowered(depth=4))
    with pytest.raises(Rejected, match="records"):
        parse(doc("a\n\n" * 50), Limits().lowered(records=20))
    assert Limits().lowered(lines=10**9).lines == Limits().lines
    for bad in ({"lines": -1}, {"lines": True}, {"nothing": 1}):
        with pytest.raises(ValueError):
            Limits().lowered(**bad)


@pytest.mark.parametrize("data, name", [(b"\xef\xbb\xbf[ver]", "utf-8"), (b"\xff\xfe[\x00", "utf-16-le"), (b"\xff\xfe\x00\x00[\x00\x00\x00", "utf-32-le"), ("é".encode(), "utf-8"), (b"\xe9", "cp1252"), (b"plain", "cp1252"), (b"[charset]\r\n\t82\r\n\tIBM CP 850\r\n\x82", "cp850"), (b"[charset]\r\n\tCP 99999\r\n", "cp1252")])
def test_codecs(data, name):
    assert envelope.decode(data, Limits()).encoding == name


def test_codec_override_and_bytes_after_the_body():
    assert parse(doc("caf\xe9"), encoding="cp850").blocks[0].text == "cafÚ"
    with pytest.raises(Rejected, match="no-such"):
        parse(doc("a"), encoding="no-such")
    d = parse(doc("caf\xe9") + "é".encode())  # what follows says nothing about the text
    assert d.encoding == "cp1252" and d.blocks[0].text == "café" and "unindexed-trailing-data" in codes(d)
    lost = parse(doc("a").replace(b"a\r\n>", b"a\x81\r\n>"))
    assert "decode-undecodable-bytes" in codes(lost) and lost.lossy
    real = parse("[ver]\n\t4\n[sty]\n\t\n[edoc]\na�\n>\n".encode())
    assert not real.lossy  # a real replacement character is no loss


# --- body ----------------------------------------------------------------------------------------------------


def test_paragraphs_join_lines_and_skip_blanks():
    assert [b.text for b in parse(doc("one \ntwo\n\n\nthree", close=">\nafter")).blocks[:2]] == ["one two", "three"]


def test_escapes_and_round_trip(spark):
    text = "a<b>c[d]e@f <;> << @@ <[> '\nsecond <+!> line"
    d = legacy.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert E.renderer("txt")(d).first().output == text.replace("\n", "\n\n") + "\n"


def test_runs_toggle_merge_and_style():
    head = STYLE + "[tag]\n\tHead\n\t2\n\t[fnt]\n\t\tTimes\n\t\t480\n\t\t255\n\t\t1\n\tHead\n\t0\n\t0\n"
    r = parse(doc("a<+!>b<+'>c<+&>d<:>e@Head@f</R><:f300>g<:f>h", styles=head)).blocks[0].runs
    assert [(t, c.bold, c.superscript, c.subscript, c.size) for t, c in r] == [("a", False, False, False, 12.0), ("b", True, False, False, 12.0), ("c", True, False, True, 12.0), ("d", True, True, False, 12.0), ("e", False, False, False, 12.0), ("f'", True, False, False, 24.0), ("g", True, False, False, 15.0), ("h", True, False, False, 24.0)]
    assert r[5][1].colour == "#ff0000" and r[5][1].family == "Times"


def test_every_command_shows_or_is_recorded():
    d = parse(doc("x<:p>y<:f240,1Arial>z<+@>c<:Q9>\n\n<:X1;if a else \"fall\">u<:X~1;if a else \"fall\"><:D1><:P1><:S+-2><:I1,2,3,0><:t5x>\n\n<:#10,-1>v<broken"))
    assert [b.text for b in d.blocks] == ["xyzc[Unsupported inline command: <:Q9>]", "fallu[Current date][Page number][Unsupported inline command: <:t5x>]", "[Unsupported inline command: <:#10,-1>]v<broken"]
    assert d.blocks[0].page_break and d.blocks[0].alignment == "left" and d.blocks[1].spacing == 1.5 and d.blocks[1].indents == [1, 2, 3, 0]
    assert codes(d) == ["unsupported-inline-tags", "unsupported-inline-tags", "inline-command-semantics-unapplied", "unterminated-inline-tag", "unsupported-inline-tags"] and d.lossy


def test_command_limit_leaves_one_marker():
    d = parse(doc("<+!>a<-!>b" * 3000))
    assert d.blocks[0].text.count(inline.MARKER_OMITTED) == 1 and "inline-command-limit" in codes(d)


def test_containers_nest_and_end():
    d = parse(doc("before<:N0,0\nnote text\n\nmore<:F\nfoot\n>\nrest\n>\nafter\n\n<:H4\nhead\n>\n<:h99\nfooter"))
    assert [b.kind for b in d.blocks] == ["paragraph", "annotation", "paragraph", "header", "footer"]
    note = d.blocks[1]
    assert [(b.kind, b.text) for b in note.children] == [("paragraph", "note text"), ("paragraph", "more"), ("footnote", ""), ("paragraph", "rest")] and note.terminated
    assert d.blocks[3].placement == "odd" and d.blocks[3].terminated and [b.text for b in d.blocks[4].children] == ["footer"]
    assert {"annotation-metadata-opaque", "footer-unknown-flag-bits"} <= set(codes(d)) and "unterminated-edoc" in codes(d)


def test_a_dynamic_field_hides_structure_over_lines():
    d = parse(doc('a<:X1;"<:N\n>\n">b\n\nend'))
    assert [b.kind for b in d.blocks] == ["paragraph", "paragraph"] and d.blocks[1].text == "end"
    assert envelope.closing_line(['x<:Z"a>', ">", '">', ">"], 0) == 3
    assert envelope.closing_line(["<:Fbad", "x", ">", ">"], 0) == 3 and envelope.closing_line(["<:FootLike>", ">"], 0) == 1


def test_text_after_a_close_is_text():
    d = parse(doc("a\n>x\nb"))
    assert d.blocks[0].text == "a>xb" and codes(d) == ["malformed-edoc-terminator"]


def test_page_breaks_lists_and_headings():
    styles = STYLE + "".join(f"[tag]\n\t{n}\n\t2\n\t[fnt]\n\t\tArial\n\t\t240\n\t\t0\n\t\t0\n\t{n}\n\t0\n\t0\n" for n in ("Bullet", "Number List", "Heading 2"))
    d = parse(doc("@Number List@one\n\n@Number List@two\n\n@Bullet@b\n\n@Number List@again\n\n<:p>plain\n\n@Heading 2@# t", styles=styles))
    assert render.Text(d).render() == "1. one\n\n2. two\n\n- b\n\n1. again\n\n\f\n\nplain\n\n# t\n"
    assert render.Markdown(d).render() == "1. one\n2. two\n- b\n1. again\n\n[Page break]\n\nplain\n\n## # t\n"
    h = render.Html(d).render()
    assert h.count("<ol>") == 2 and h.count("<li") >= 4 and "<h2>" in h and '<hr class="page-break"' in h


# --- frames, tables, layouts, styles ---------------------------------------------------------------------------

GRID = "[frm]\n\t1\n\t524288\n\t0\n\t0\n\t900\n\t900\n\t[tbl]\n\t\t2 2 300 10 600 20 4 43 43\n\t\t[h]\n\t\t\t0 300 10 16 0 0 0\n\t\t\t1 400 10 2 0 0 0\n\t\t[w]\n\t\t\t0 600 20 2 0\n\t\t\t1 900 20 2 0\n\t[data]\n\t\t\t0 0 384 1 2 11 0 1 0 0 0 0\n\t\t\tAn\n\t\t\tchor\n\t\t\t>\n\t\t\t0 1 128 0 1 0 0 0 0 0 0 0\n\t\t\t>\n\t\t\t1 0 8 0 0 0 0 1 1 0 0 0\n\t\t\tleft\n\n\t\t\tpart | two\n\t\t\t>\n\t\t\t=formula\n\t\t\t1 1 16 0 0 0 0 1 0 0 0 0\n\t\t\tright\n\t\t\t>\n\t[e]\n"


def test_table_in_every_sink():
    d = parse(doc("A<:t0>B", GRID))
    assert render.Text(d).render() == "A\n\nAnchor\t\nleft / part | two\tright\n\nB\n"
    assert render.Markdown(d).render() == "A\n\n| Anchor |  |\n| --- | --- |\n| left<br>part \\| two | right |\n\nB\n"
    h = render.Html(d).render()
    assert '<thead>\n<tr><th colspan="2">' in h and '<td style="text-align:left">' in h and "<colgroup>" in h
    assert "table-formula-not-recalculated" in codes(d) and d.tables[0]["cells"][1]["covered"]
    for write in (packages.odt, packages.docx):
        z = zipfile.ZipFile(io.BytesIO(write(d)))
        assert write(d) == write(d)
        for n in z.namelist():
            if n.endswith((".xml", ".rels")):
                xml.dom.minidom.parseString(z.read(n))
    assert b'table:number-columns-spanned="2"' in zipfile.ZipFile(io.BytesIO(packages.odt(d))).read("content.xml")
    p = packages.pdf(d)
    assert p.startswith(b"%PDF-1.4") and p.endswith(b"%%EOF\n") and p == packages.pdf(d)


def test_short_table_records_are_kept():
    """Headers of five numbers without closes, and a definition of four: cells are read, fields are recorded."""
    frame = "[frm]\n\t1\n\t524288\n\t0\n\t0\n\t9\n\t9\n\t[tbl]\n\t\t2 2 0 0\n\t[data]\n\t\t\t0 0 0 0 0\n\t\t\tA1\n\t\t\t0 1 0 0 0\n\t\t\tB1\n\t\t\t1 0 0 0 0\n\t\t\tA2\n\t[e]\n"
    d = parse(doc("<:t0>", frame))
    assert "A1\tB1\nA2\t" in render.Text(d).render() and "table-fields-opaque" in codes(d)
    assert d.blocks[0].children[-1].rows[0][0]  # without a definition the first row is the header


def test_overlapping_and_incomplete_merges_stay_cells():
    cell = lambda r, c, f, a=0, b=0, t="": f"\t\t\t{r} {c} {f} {a} {b} 0 0 0 0 0 0 0\n" + (f"\t\t\t{t}\n" if t else "") + "\t\t\t>\n"
    head = "[frm]\n\t1\n\t524288\n\t0\n\t0\n\t9\n\t9\n\t[tbl]\n\t\t2 2 0 0 0 0 0 0 0\n\t[data]\n"
    ok = parse(doc("<:t0>", head + cell(0, 0, 256, 2, 2, "x") + cell(0, 1, 128, 0, 1) + cell(1, 0, 128, 1, 0) + cell(1, 1, 128, 1, 1)))
    assert "table-merge-unresolved" not in codes(ok) and ok.tables[0]["cells"][0]["span"] == (2, 2)
    for bad in (cell(1, 1, 128, 1, 1, "text"), cell(1, 1, 128, 0, 1), cell(1, 1, 0), ""):
        d = parse(doc("<:t0>", head + cell(0, 0, 256, 2, 2, "x") + cell(0, 1, 128, 0, 1) + cell(1, 0, 128, 1, 0) + bad))
        assert "table-merge-unresolved" in codes(d) and d.tables[0]["cells"][0]["span"] == (1, 1)


def test_two_tables_in_a_document(spark):
    from palimpsest.plans import statistics as S

    d = spark.createDataFrame([(1, doc("<:t0><:t1>", GRID + GRID))], "doc_id long, content binary")
    got = S.grid_report(E.relation(d, "tables"), E.relation(d, "cells")).collect()
    assert len(got) == 2 and all(r.complete and r.capacity == 4 for r in got)


def test_frames_anchors_and_labels():
    text = lambda flags, box="\t0\n\t0\n\t90\n\t90": f"[frm]\n\t1\n\t{flags}\n{box}\n\t[txt]\nframe {flags}\n>\n"
    d = parse(doc("a<:A0>b<:A0>c<:t0>d<:A7>", text(524288) + text(256) + text(524288, "\t9\n\t9\n\t9\n\t9") + text(0)))
    assert [r[3] for r in d.anchors] == ["placed", "duplicate", "duplicate", "out-of-range"]
    assert [f.placement for f in d.frames] == ["anchored", "repeating", "anchored", "fixed-page"] and not d.frames[2].usable
    t = render.Text(d).render()
    assert "a\n\nframe 524288\n\nb" in t and "[Frame: anchored; body; text; geometry reflowed]" in t  # the unusable one has a label
    assert {"duplicate-frame-anchor", "frame-anchor-out-of-range", "unreferenced-anchored-frame", "invalid-frame-geometry", "unanchored-frame-reflowed"} <= set(codes(d))


def test_layouts_and_their_furniture():
    side = "\t\t15840\n\t\t12240\n\t\t0\n\t\t1440\n\t\t1440\n\t\t1\n\t\t1440\n\t\t1440\n\t\t0\n"
    lay = f"[lay]\n\tMain\n\t257\n\t[rght]\n{side}\t[hrght]\n\t\t[lyfrm]\n\t\t\t1\n\t\t\t2048\n\t\t\t0\n\t\t\t0\n\t\t\t90\n\t\t\t90\n\t\t[txt]\nTop\n>\n\t[lft]\n\t\t1\n\t[junk]\n\t\tx\n"
    d = parse(doc("x", lay))
    m = d.layouts[0]
    assert m["paper"] == "letter" and m["orientation"] == "landscape" and m["valid"] and m["odd"]["valid"] and not m["even"]["valid"]
    assert render.body_width(d) == 12240 - 2880 and render.page_boxes(d)[1] == (8.5, 11.0, 1.0, 1.0, 1.0, 1.0)
    top = next(b for b in d.blocks if b.kind == "header")
    assert top.placement == "odd" and top.origin == "layout" and top.children[0].text == "Top" and top.terminated
    assert {"malformed-page-geometry", "layout-subrecord-opaque"} <= set(codes(d))


def test_style_records_and_chain():
    styles = "[tag]\n\tA\n\t2\n\t[fnt]\n\t\tTimes\n\t\t200\n\t\t65535\n\t\t131\n\t[algn]\n\t\t4\n\t\t1\n\t\t5\n\t\t720\n\t\t1440\n\t[spc]\n\t\t2\n\t\t0\n\t\t0\n\t\t60\n\t\t100\n\t\t1\n\t\t100\n\t[brk]\n\t\t4\n\tB\n\t0\n\t0\n"
    d = parse(doc("x", styles=styles))
    s = d.styles["A"]
    assert s.char == inline.Char(True, True, False, True, family="Times", size=10.0, colour="#ffff00") and s.alignment == "center"
    assert (s.left, s.first, s.spacing, s.before, s.after, s.following, s.shortcut) == (1.0, -0.5, 1.5, 3.0, 5.0, "B", 2)
    assert codes(d) == ["style-subrecords-opaque", "style-alignment-all-indent-unapplied"]
    d.styles["B"] = type(s)("B", 0, 1)
    d.styles["B"].parent, s.parent = "A", "b"  # a cycle, by another case
    assert [x.name for x in render.style_chain(d, "b")] == ["A", "B"]
    assert render.merged(inline.Char(superscript=True, size=9.0), inline.Char(bold=True, subscript=True)) == inline.Char(bold=True, superscript=True, size=9.0)


def test_column_widths_add_up():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 20)
        b = render.Block("table", 0, definition=None if rng.random() < 0.3 else [1, n, 0, 0, rng.randrange(900), rng.randrange(9), 0, 0, 0], columns={k: [k, rng.randrange(900), rng.randrange(9), 0, 0] for k in range(n) if rng.random() < 0.5})
        w = render.column_widths(b, n, total := rng.randrange(n, 9000))
        assert sum(w) == total and min(w) >= 1 and len(w) == n


def test_embedded_assets_and_damage():
    bmp = bytes.fromhex("424D3A000000000000003600000028000000010000000100000001001800000000000400000000000000000000000000000000000000") + b"\x01\x02\x03\0"
    text = doc("a<:A0>b", "[frm]\n\t1\n\t524288\n\t0\n\t0\n\t9\n\t9\n\t[isd]\n\t\t.X7\n")
    row = f"[Embedded]\r\n7 .bmp {len(text)} {len(bmp)} 0 0\r\n8 .xyz 5 5 0 0\r\nbad row\r\n".encode()
    d = parse(text + bmp + b"\r\n" + row + f"{len(text) + len(bmp) + 2:08d}\r\n".encode())
    assert [(a["id"], a["verified"], a["status"], a["frame"]) for a in d.assets] == [("7", True, "ok", 0), ("8", False, "unsupported", None)]
    assert "data:image/bmp;base64," in render.Html(d).render() and d.source.pointer_ok
    assert {"embedded-directory-malformed", "embedded-offset-invalid", "unreferenced-embedded-asset"} <= set(codes(d))
    assert "embedded-directory-pointer-mismatch" in codes(parse(text + bmp + b"\r\n" + row + b"00000001\r\n"))


def test_nul_recovery_keeps_a_digest():
    d = parse(doc("a\n\nb\0\nhidden", close=""))
    assert "unterminated-edoc-opaque-tail" in codes(d) and not any(b.text == "hidden" for b in d.blocks) and loss("unterminated-edoc-opaque-tail") == "content"


def test_parser_is_total_on_damage():
    rng = random.Random(4)
    whole = doc("A<:t0>B<:N1\nx\n>\n@Body Text@<+!>z<:f1,2,3,4,5>", GRID)
    for _ in range(1500):
        b = bytearray(whole)
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(b))
            if rng.random() < 0.5:
                b[at] = rng.randrange(256)
            else:
                del b[at : at + rng.randrange(30)]
        try:
            d = parse(bytes(b))
        except Rejected:
            continue
        for r in (render.Text, render.Markdown, render.Html):
            r(d).render()
        for write in (packages.odt, packages.docx, packages.pdf):
            write(d)
        for name, (fn, _) in E.RELATIONS.items():
            list(fn(d))


def test_unknown_renderer_lists_choices():
    with pytest.raises(ValueError, match="docx, html, json, markdown, odt, pdf, text"):
        E.renderer("pdfx")


def test_render_caps_leave_markers():
    frame = "[frm]\n\t1\n\t524288\n\t0\n\t0\n\t9\n\t9\n\t[tbl]\n\t\t400 1 0 0 0 0 0 0 0\n\t[data]\n" + "".join(f"\t\t\t{k} 0 0 0 0 0 0 0 0 0 0 0\n\t\t\tv{k}\n\t\t\t>\n" for k in range(400))
    d = parse(doc("<:t0>", frame))
    assert render.Text(d).render().endswith("v389\n[Table content omitted at safe rendering limit]\n")
    assert "[Text value truncated" in render.Text(parse(doc("x" * 1_000_010))).render()
    assert render.Budget(5).take("y" * 900_000) == ("[Text content omitted at safe document rendering limit]", True)


# --- files ---------------------------------------------------------------------------------------------------


def test_scan_bounds_are_pushed_down_and_nothing_is_shuffled(spark, tmp_path):
    (tmp_path / "a.SAM").write_bytes(b"x" * 10)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.sam").write_bytes(b"y" * 100)
    (tmp_path / "c.txt").write_bytes(b"z")
    root = str(tmp_path)
    s = legacy.scan(spark, [root, root, f"{root}/sub", f"{root}/c.txt", f"{root}/a.SAM"], max_bytes=50)
    assert sorted((r.doc_id.rpartition("/")[2], r.length, r.status) for r in s.collect()) == [("a.SAM", 10, "ok"), ("b.sam", 100, "error"), ("c.txt", 1, "ok")]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "LessThanOrEqual(length" in plan
    assert [r.path.rpartition("/")[2] for r in legacy.discover(spark, [root]).collect()] == ["a.SAM", "b.sam"]
    assert legacy.listing(spark, [root], recursive=False).count() == 1


def test_inventory_digest_ignores_order(spark):
    f = spark.createDataFrame([(f"p{k}", bytes([k])) for k in range(20)], "path string, content binary")
    inv = legacy.inventory(f, "path", "content")
    a, b = legacy.inventory_digest(inv, "path").first(), legacy.inventory_digest(inv.orderBy(F.desc("path")).repartition(3), "path").first()
    assert a == b and a.file_count == 20 and legacy.inventory_digest(inv.limit(19), "path").first().digest != a.digest
    later = inv.where("path <> 'p3'").withColumn("size", F.when(F.col("path") == "p4", 9).otherwise(F.col("size")))
    assert {(r.path, r.change) for r in legacy.changed(inv, later, "path", ["size", "sha256"]).collect()} == {("p3", "gone"), ("p4", "changed")}


# --- operators -----------------------------------------------------------------------------------------------


def test_asof_strict_and_forward(spark):
    e = spark.createDataFrame([("k", 1, 5), ("k", 2, 10), ("x", 3, 1)], "k string, id int, t int")
    m = spark.createDataFrame([("k", 5), ("k", 8)], "k string, m int")
    pick = lambda **kw: {r.id: r.matched for r in g.asof(e, m, ["k"], "t", "m", **kw).collect()}
    assert pick() == {1: 5, 2: 8, 3: None}
    assert pick(strict=True) == {1: None, 2: 8, 3: None}
    assert pick(forward=True) == {1: 5, 2: None, 3: None}
    assert pick(forward=True, strict=True) == {1: 8, 2: None, 3: None}
    assert {r.id: (r.before, r.after) for r in g.asof_both(e, m, ["k"], "t", "m").collect()} == {1: (5, 5), 2: (8, None), 3: (None, None)}


def test_distribution_is_exact_at_any_partitioning(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 7, 500):
        v = [(rng.randrange(40), float(rng.randrange(9))) for _ in range(n)]
        d = spark.createDataFrame(v + [(1, None)], "k int, v double").repartition(5)
        r = g.distribution(d, "v").first()
        s = pd.Series([x for _, x in v])
        assert r.n == n and (n == 0 and r.median is None or n and r.median == s.median() and r.low == s.min() and r.high == s.max())


def test_bounded_int_and_spacing(spark):
    v = ["12", "-7", "+3", "2147483648", "x", "", "123456789012345678901", None]
    d = spark.createDataFrame([(x,) for x in v], "s string")
    assert [r[0] for r in d.select(scalars.bounded_int(F.col("s"))).collect()] == [12, -7, 3, None, None, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(-1,), (-2,), (-3,), (40,)], "n int").select(scalars.line_spacing(F.col("n"))).collect()] == [1.0, 1.5, 2.0, 2.0]
    assert [inline.line_spacing(x) for x in (-1, -2, -3, 40)] == [1.0, 1.5, 2.0, 2.0]


def test_bitmap_rules():
    import struct

    head = lambda size, depth=24: b"BM" + struct.pack("<IIIIiiHHI", size, 0, 54, 40, 1, 1, 1, depth, 0) + bytes(20)
    assert legacy.bitmap(pd.Series([head(58) + bytes(4), head(58) + bytes(3), head(58, 5) + bytes(4), None, b"BM"])).tolist() == [True, False, False, False, False]


def test_payload_decoders_are_total():
    from palimpsest.sources import payloads

    rng = random.Random(1)
    for _ in range(3000):
        b = bytes(rng.randrange(256) for _ in range(rng.randrange(80)))
        b = rng.choice([b"", b"SM\x02\x01", b"SS", b"\xd7\xcd\xc6\x9a", b"\x01\x00\x09\x00\x00\x03"]) + b
        assert payloads.metafile(b)[0] and payloads.drawing(b)[0] and payloads.preview(b)[0]
    assert payloads.preview(b"SS" + bytes([9, 0, 1, 0, 2, 0, 1, 1]) + bytes(8) + b"\x80\x80")[3] == b"\xff" + b"\x00" * 7 + b"\xff"


def metafile(depth=24, width=3, height=2, wrong=None, **over):
    """A metafile of one picture whose pixels count up, and what they must decode to."""
    import struct

    colours = 0 if depth == 24 else 1 << depth
    stride = (width * depth + 31) // 32 * 4
    pixels = [[(x + y * width) % (colours or 256) for x in range(width)] for y in range(height)]
    rows, want = [], []
    for y in range(height):
        bits = "".join((f"{p:08b}" * 3 if depth == 24 else f"{p:0{depth}b}") for p in pixels[y]).ljust(stride * 8, "0")
        rows.insert(0, int(bits, 2).to_bytes(stride, "big"))
        want += [bytes((p,) * 3) if depth == 24 else bytes((p, 2 * p % 256, 7)) for p in pixels[y]]
    table = b"".join(bytes((7, 2 * k % 256, k, 0)) for k in range(colours))
    dib = struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, 0, 0, 0, 0, 0, 0) + table + b"".join(rows)
    record = lambda f, body: struct.pack("<IH", 3 + len(body) // 2, f) + body
    blit = record(0x0B41, struct.pack("<Ihhhhhhhh", 0xCC0020, height, width, 0, 0, height, width, 0, 0) + dib)
    body = record(0x00F7, struct.pack("<HH", 0x300, 1) + bytes(4)) + record(0x0234, b"\0\0") + record(0x0035, b"") + record(0x020B, bytes(4)) + record(0x020C, struct.pack("<hh", height, width)) + blit + (wrong or b"") + record(0, b"")
    return struct.pack("<HHHIHIH", 1, 9, 0x300, 9 + len(body) // 2, 1, len(blit) // 2, 0) + body, b"".join(want)


def test_metafile_pixels_and_rejections():
    import struct

    from palimpsest.sources import payloads

    for depth in (1, 4, 8, 24):
        data, want = metafile(depth, 5, 3)
        m = payloads.decode_metafile(data)
        assert (m["code"], m["width"], m["height"], m["rgb"]) == ("ok", 5, 3, want)
    data, _ = metafile()
    code = lambda b: payloads.decode_metafile(b)["code"]
    assert code(None) == "truncated-header" and code(data[:-1]) == "file-size-mismatch" and code(b"\x02" + data[1:]) == "unsupported-header"
    assert code(metafile(wrong=struct.pack("<IH", 3, 0x0626))[0]) == "unsafe-escape" and code(metafile(wrong=struct.pack("<IH", 3, 0x0999))[0]) == "unsupported-record"
    assert code(metafile(wrong=struct.pack("<IH", 2, 1))[0]) == "invalid-record-size"
    assert payloads.decode_metafile(data, max_pixels=5)["code"] == "pixel-limit" and payloads.decode_metafile(data, max_side=2)["code"] == "dimension-limit"
    rng = random.Random(6)
    for _ in range(1500):
        b = bytearray(data)
        for _ in range(rng.randrange(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        m = payloads.decode_metafile(bytes(b))
        assert (m["rgb"] is None) == (m["code"] != "ok")


def test_text_for_standard_fonts(spark):
    x = spark.createDataFrame([("a‮b\x01\U0001f600", ), ("x" * 1100, ), ("e" + "́" * 70, ), (None, ), ("אb", )], "t string")
    got = [r[0] for r in x.select(scalars.sanitize(F.col("t"))).collect()]
    assert got[0] == "a‮b��" and got[1] == "x" * 1024 + "[...]" and got[2] == "e" + "́" * 64 + "�" and got[3] is None
    assert [r[0] for r in x.select(scalars.direction(F.col("t"))).collect()] == ["ltr", "ltr", "ltr", None, "rtl"]


def test_a_set_of_any_number_of_documents_is_accepted(spark):
    many = spark.range(100_001).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".sam")).alias("path"))
    assert tuple(legacy.enumeration(many).first()) == (100_001, 0, 0, 0, True)
    assert not legacy.enumeration(many, cap=99_999).first()["accepted"]
    assert not legacy.enumeration(many.unionByName(many.limit(1).select(F.upper("path").alias("path")))).first()["accepted"]


TABLE = "[frm]\n\t1\n\t524288\n\t0\n\t0\n\t100\n\t100\n\t[tbl]\n\t\t2 2 300 10 600 20 0 5 5\n\t\t[h]\n\t\t\t0 200 10 16 0 0 0\n\t\t\t0 210 10 0 0 0 0\n\t\t\t5 1 1 0 0 0 0\n\t\t[w]\n\t\t\t1 600 20 0 0\n\t[data]\n{}\t[e]\n"


def test_tables_of_the_plain_form_are_what_the_parser_reads():
    from palimpsest.parsing import quick

    cell = "\t\t\t{} {} {} {} 0 0 7 1 0 0 0 0\n{}\t\t\t>\n"
    rng, plain, read = random.Random(4), 0, 0
    for k in range(1500):
        cells = "".join(cell.format(rng.randrange(2), rng.randrange(2), rng.choice((0, 8, 16, 128, 256, 384)), rng.randrange(3), rng.choice(("", "\t\t\tR\n", "\t\t\t<+A>ab1\n"))) for _ in range(rng.randrange(1, 6)))
        b = doc("<:t0>", TABLE.format(cells))
        if k % 3:
            at = rng.randrange(len(b))
            b = b[:at] + rng.choice((b"9", b" ", b"\t", b"\r\n", b">", b"[", b"<", b"\x1c", b"128 ", b"\xe9", b"")) + b[at + rng.randrange(2) :]
        read += 1
        if q := quick.tables(b):
            plain += 1
            d = parse(b)
            for r in E.TABULAR:
                assert list(E.RELATIONS[r][0](q)) == list(E.RELATIONS[r][0](d)), (r, b)
    assert read // 3 < plain < read


def test_relations_of_a_row_a_table_are_the_reports_over_the_others(spark):
    from palimpsest.plans import statistics as S

    cells = ("\t\t\t0 0 8 0 0 0 0 1 0 0 0 0\n\t\t\tx\n\t\t\t>\n\t\t\t0 0 8 0 0 0 0 1 0 0 0 0\n\t\t\t>\n", "\t\t\t9 9 8 0 0 0 0 1 0 0 0 0\n\t\t\tx\n\t\t\t>\n", "".join(f"\t\t\t{r} {c} 0 0 0 0 0 0 0 0 0 0\n\t\t\t>\n" for r in (0, 1) for c in (0, 1)), "")
    odd = [TABLE.format(c) for c in cells] + [TABLE.format(cells[0]).replace("2 2 300", x) for x in ("0 2 300", "1 3 300", "2 300")] + ["[frm]\n\t1\n\t524288\n\t[tbl]\n\t\t1 1 0 0 0 0 0 0 0\n\t[data]\n\t[e]\n", TABLE.format(cells[0]) + TABLE.format(cells[2])]
    docs = spark.createDataFrame([(k, doc("<:t0>", x)) for k, x in enumerate(odd)], "doc_id int, content binary").repartition(2)
    r = {n: E.relation(docs, n).cache() for n in E.TABULAR}
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert r["grids"].count() == 10 and same(r["grids"], S.grid_report(r["tables"], r["cells"]))
    assert r["extents"].count() and same(r["extents"], S.extents(r["tables"], r["metrics"]))
    for f in ("row", "column"):
        assert same(S.index_totals(r["indexes"].where(f"family = '{f}'")), S.index_report(r["tables"], r["metrics"], f))


def test_reports_on_tables_parse_each_document_once(spark):
    from palimpsest.plans import corpus_queries as c

    for name in ("column_index_report", "row_index_report", "table_extents", "coordinate_report", "table_grids", "tail_report", "cell_field_report", "promoted_furniture"):
        plan = c.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan, name


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_regions_and_furniture_of_a_document_are_those_of_the_joined_relations(spark):
    from palimpsest.plans import statistics as S

    rng = random.Random(8)
    side = lambda m, left: f"\t[{m}]\n" + "".join(f"\t\t{x}\n" for x in (15840, 12240, 0, left, rng.choice((200, 1440)), 1, rng.choice((200, 1440)), 1440, 0))
    head = lambda m: f"\t[{m}]\n\t\t[lyfrm]\n\t\t\t1\n\t\t\t2048\n\t\t\t0\n\t\t\t0\n\t\t\t900\n\t\t\t900\n\t\t[txt]\n" + "\n\n".join("l" * rng.choice((1, 300)) for _ in range(rng.randrange(4))) + rng.choice(("\n>\n", "\n"))
    made = []
    for k in range(250):
        lay = "".join(f"[lay]\n\tMain\n\t{rng.choice((1, 513, 1025))}\n" + side("rght", rng.choice((1440, 99999))) + (side("lft", 1000) if rng.random() < 0.5 else "") + "".join(head(rng.choice(("hrght", "hlft", "frght", "flft"))) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(3)))
        body = "\n\n".join("".join(rng.choice(("<:#283,9000>", "<:#0,0>", "<:#-5,7>", "<:f240,1Arial>", "<:f,1Arial>", "<:I1,5,0,0>", "word ")) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(5)))
        made.append((k, doc(body, lay)))
    docs = spark.createDataFrame(made, "doc_id int, content binary").repartition(2)
    r = {n: E.relation(docs, n).cache() for n in ("commands", "layouts", "blocks", "regions", "promoted")}
    assert r["regions"].count() > 50 and _same(r["regions"], S.region_observations(r["commands"], r["layouts"]).select(*r["regions"].columns))
    assert r["promoted"].count() > 5 and _same(r["promoted"], E.promoted(r["blocks"], r["layouts"]))
    both = E.together(docs, ("commands", "layouts", "regions"))
    assert all(_same(both[n], r[n]) for n in ("commands", "layouts", "regions"))
    tables = E.together(spark.createDataFrame([(1, doc("<:t0>", TABLE.format("\t\t\t0 0 8 0 0 0 0 1 0 0 0 0\n\t\t\tx\n\t\t\t>\n"))), (2, None), (3, b"x")], "doc_id int, content binary"), ("grids", "cells"))
    assert tables["grids"].count() == tables["cells"].count() == 1


def test_fonts_are_listed_once_a_document(spark):
    body = "".join(f"<:f{k},1Courier>w<:f>v" for k in range(20, 60))
    f = E.relation(spark.createDataFrame([(1, doc(body))], "doc_id int, content binary"), "fonts")
    assert sorted((r["source"], r["family"]) for r in f.collect()) == [("run", "Arial"), ("run", "Courier"), ("style", "Arial")]


def test_batches_and_partitions_follow_the_input(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(doc("a")).alias("content")).repartition(1)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    r = E.renderer("odt")(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2048 and r.count() == 5000
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)
    few = spark.range(1 << 20)
    assert g.parts(few) == max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))) and g.parts(few, 1 << 16) == 128
