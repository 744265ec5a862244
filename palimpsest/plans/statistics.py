"""Corpus statistics over the engine's relations: aggregates per table first, then over the corpus, so that no group is larger
than one table or one published value. Groups of fewer than `least` rows are never published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.generic import distribution, suppressed_topk
from .engine import stored

LEAST, TOLERANCE, MAX_GRID = 5, 3, 100_000


def n_if(c) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def bit(flags: Column, b: int) -> Column:
    return flags.bitwiseAND(F.lit(b).cast("long")) != 0


def record_shapes(shapes: DataFrame, least: int = LEAST) -> DataFrame:
    """Records by family and number of fields: how many there are, how many are as expected; rare ones are left out."""
    g = shapes.groupBy("family", "arity").agg(F.count("*").alias("records"), F.count_if("canonical").alias("canonical"))
    return g.where(F.col("records") >= least)


def index_report(tables: DataFrame, metrics: DataFrame, family: str, key: str = "doc_id") -> DataFrame:
    """Row or column metrics against their table's declared size: indexes inside it and inside the other dimension, complete
    sets, duplicates, values equal to the table's defaults."""
    own, other, size, gap = ("rows", "cols", "row_height", "row_gutter") if family == "row" else ("cols", "rows", "col_width", "col_gutter")
    d = tables.where("rows is not null").select(key, "table_no", F.col(own).alias("own"), F.col(other).alias("other"), F.col(size).alias("size"), F.col(gap).alias("gap"))
    m = metrics.where(F.col("family") == family).join(d, [key, "table_no"], "left")
    per = m.groupBy(key, "table_no").agg(
        F.count("*").alias("n"), F.first("own").alias("own"), F.first("other").alias("other"), F.countDistinct("index").alias("distinct"), F.max("index").alias("top"),
        n_if(F.col("index") < F.col("own")).alias("inside"), n_if(F.col("index") < F.col("other")).alias("inside_other"), n_if(F.col("extent") == F.col("size")).alias("default_extent"), n_if(F.col("gutter") == F.col("gap")).alias("default_gutter"),
    )
    return index_totals(per)


def index_totals(per: DataFrame) -> DataFrame:
    """One row over the tables' metrics of one family (the relation indexes)."""
    known, differ = F.col("own").isNotNull(), F.col("own") != F.col("other")
    total = lambda c, when=known: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), total("n").alias("compared"), total("inside").alias("inside"), n_if(known & (F.col("inside") == F.col("n"))).alias("tables_all_inside"),
        n_if(known & (F.col("distinct") == F.col("own")) & (F.col("top") == F.col("own") - 1)).alias("tables_complete"), n_if(known & (F.col("top") == F.col("own") - 1)).alias("tables_top_matches"),
        (total("n") - total("distinct")).alias("duplicates"), total("inside_other").alias("inside_other"), n_if(known & (F.col("inside_other") == F.col("n"))).alias("tables_all_inside_other"),
        total("n", known & differ).alias("compared_differing"), total("inside_other", known & differ).alias("inside_other_differing"), total("default_extent").alias("default_extent"), total("default_gutter").alias("default_gutter"),
    )


def grid_report(tables: DataFrame, cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per table: declared capacity, cell records, distinct places, records inside the grid and inside the swapped one, whether each place is there."""
    d = tables.select(key, "table_no", "rows", "cols")
    inside = (F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols"))
    swapped = (F.col("row") < F.col("cols")) & (F.col("col") < F.col("rows"))
    c = cells.where("fields is not null or row is not null").join(d, [key, "table_no"])
    a = c.groupBy(key, "table_no").agg(F.count("*").alias("cells"), F.countDistinct("row", "col").alias("places"), n_if(inside).alias("inside"), n_if(swapped).alias("inside_swapped"), F.max("row").alias("top_row"), F.max("col").alias("top_col"), F.min("row").alias("low_row"), F.min("col").alias("low_col"))
    j = d.join(a, [key, "table_no"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    capacity = (F.col("rows").cast("long") * F.col("cols")).alias("capacity")
    complete = F.coalesce((F.col("places") == F.col("rows").cast("long") * F.col("cols")) & (F.col("inside") == F.col("cells")), F.lit(False))
    return j.select(key, "table_no", "rows", "cols", capacity, zero("cells"), zero("places"), zero("inside"), zero("inside_swapped"), "top_row", "top_col", "low_row", "low_col", complete.alias("complete"))


def coordinate_report(grids: DataFrame) -> DataFrame:
    """One row over all tables, from grid_report."""
    has = F.col("cells") > 0
    differ = F.col("rows") != F.col("cols")
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return grids.where("rows is not null").agg(
        F.count("*").alias("tables"), total("capacity").alias("capacity"), total("cells").alias("cells"), total("inside").alias("inside"), n_if(has & (F.col("inside") == F.col("cells"))).alias("tables_all_inside"), n_if(F.col("low_row") == 0).alias("low_row_zero"), n_if(F.col("low_col") == 0).alias("low_col_zero"),
        n_if(F.col("top_row") == F.col("rows") - 1).alias("top_row_matches"), n_if(F.col("top_col") == F.col("cols") - 1).alias("top_col_matches"), n_if("complete").alias("complete"), (total("cells") - total("places")).alias("duplicates"),
        total("inside_swapped").alias("inside_swapped"), total("cells", differ).alias("cells_differing"), total("inside_swapped", differ).alias("inside_swapped_differing"),
    )


def merge_report(cells: DataFrame) -> DataFrame:
    """Anchors and members, and how many of them form complete rectangles (the parser resolves those in order of place)."""
    f = F.col("fields")[2]
    anchor, member = bit(f, 256), bit(f, 128) & ~bit(f, 256)
    resolved = (F.col("row_span") * F.col("col_span") > 1) | ((F.greatest(F.col("fields")[3], F.lit(1)) * F.greatest(F.col("fields")[4], F.lit(1))) == 1)
    return cells.where("fields is not null").agg(
        n_if(anchor).alias("anchors"), n_if(member).alias("members"), n_if(anchor & bit(f, 128)).alias("anchors_with_member_bit"), n_if(anchor & resolved).alias("anchors_resolved"), n_if(anchor & ~resolved).alias("anchors_open"),
        n_if(member & F.col("covered")).alias("members_covered"), n_if(member & ~F.col("covered")).alias("members_open"), n_if(member & F.col("raw_empty")).alias("members_empty"),
    )


def span_pairs(cells: DataFrame, anchors: bool = True, k: int = 32, least: int = LEAST) -> DataFrame:
    """The most frequent pairs of joined rows and columns of anchors, or offsets of members."""
    f = F.col("fields")[2]
    want = bit(f, 256) if anchors else bit(f, 128) & ~bit(f, 256)
    pairs = cells.where(want).select(F.concat_ws("x", F.col("fields")[3], F.col("fields")[4]).alias("pair"))
    return suppressed_topk(pairs, "pair", k, least)


def extents(tables: DataFrame, metrics: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per table: heights of all declared rows and widths of all declared columns, where a stated metric overrides the
    default; of several for one index the last holds."""
    last = metrics.groupBy(key, "table_no", "family", "index").agg(F.max_by(F.col("extent") + F.col("gutter"), "record_no").alias("own"))
    d = tables.where("rows is not null")
    s = last.join(d.select(key, "table_no", "rows", "cols"), [key, "table_no"]).where(F.col("index") < F.when(F.col("family") == "row", F.col("rows")).otherwise(F.col("cols")))
    s = s.groupBy(key, "table_no").agg(*[F.coalesce(F.sum(F.when(F.col("family") == f, F.col("own"))), F.lit(0)).alias(f"{f}_own") for f in ("row", "column")], *[F.count_if(F.col("family") == f).alias(f"{f}_n") for f in ("row", "column")])
    j = d.join(s, [key, "table_no"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    height = z("row_own") + (F.col("rows") - z("row_n")) * (F.col("row_height") + F.col("row_gutter"))
    width = z("column_own") + (F.col("cols") - z("column_n")) * (F.col("col_width") + F.col("col_gutter"))
    return j.select(key, "table_no", height.cast("long").alias("height"), width.cast("long").alias("width"), (F.col("bottom") - F.col("top")).alias("outer_height"), (F.col("right") - F.col("left")).alias("outer_width"), "tail_1", "tail_2")


def tail_report(ext: DataFrame) -> DataFrame:
    """One row: what frames measure beyond their tables against the stated tail, exactly and within three twips."""
    h, w = F.col("outer_height") - F.col("height") - F.col("tail_1"), F.col("outer_width") - F.col("width") - F.col("tail_1")
    return ext.agg(F.count("*").alias("tables"), n_if(F.col("tail_1") == F.col("tail_2")).alias("equal_tails"), F.count(h).alias("compared"), n_if(h == 0).alias("height_exact"), n_if(F.abs(h) <= TOLERANCE).alias("height_near"), n_if(w == 0).alias("width_exact"), n_if(F.abs(w) <= TOLERANCE).alias("width_near"))


def cell_field_report(cells: DataFrame) -> DataFrame:
    """One row: presence of content, protection, borders and shading, and alignment flags against alignment commands."""
    f = F.col("fields")
    low = f[2].bitwiseAND(F.lit(56).cast("long"))
    want = F.create_map(*[x for k, v in {"left": 8, "right": 16, "center": 24, "justify": 32}.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    agree = F.size(F.filter("alignments", lambda a: want[a] == low))
    return cells.where("fields is not null").agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.size("alignments")), F.lit(0)).alias("alignment_observations"), F.coalesce(F.sum(agree), F.lit(0)).alias("alignment_matches"),
        n_if((f[7] == 1) & (F.col("material") > 0)).alias("content_flag_with_text"), n_if((f[7] == 1) & (F.col("material") == 0)).alias("content_flag_without_text"), n_if((f[7] == 0) & (F.col("material") > 0)).alias("text_without_content_flag"), n_if(~f[7].isin(0, 1)).alias("content_flag_other"),
        n_if(f[8] == 1).alias("protected"), n_if(~f[8].isin(0, 1)).alias("protected_other"), n_if((f[5] != 0) & (f[9] != 0)).alias("shaded_with_r0"), n_if(f[6] > 65535).alias("wide_borders"), n_if(f[10] == 0).alias("r1_zero"), n_if(f[11] == 0).alias("r2_zero"), n_if(F.col("lines_after") > 0).alias("with_lines_after"),
    )


def border_nibbles(cells: DataFrame) -> DataFrame:
    """nibble (low to high), value, n: how the border word's four nibbles are distributed."""
    v = cells.where("fields is not null").select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(12), F.lit(4)), lambda s: F.call_function("shiftright", F.col("fields")[6], s).bitwiseAND(F.lit(15).cast("long")))).alias("nibble", "value"))
    return v.groupBy("nibble", "value").agg(F.count("*").alias("n"))


def primary_width(layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body_width: of the first layout with a valid side, the odd side before the even."""
    width = lambda g: F.when(F.col(g)["valid"], F.col(g)["width"] - F.col(g)["left"] - F.col(g)["right"])
    return layouts.withColumn("w", F.coalesce(width("odd"), width("even"))).where("w is not null").groupBy(key).agg(F.min_by("w", "layout_index").alias("body_width"))


def region_observations(commands: DataFrame, layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, width, body_width, font_size (of the first font command after it in its unit), material."""
    w = Window.partitionBy(key, "unit").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    size = F.first(F.when(F.col("kind") == "f", F.col("values")[0]), ignorenulls=True).over(w)
    c = commands.withColumn("font_size", size).where("kind = '#' and values[0] >= 0 and values[1] >= 0")
    return c.join(primary_width(layouts, key), key, "left").select(key, F.col("values")[0].alias("first"), F.col("values")[1].alias("width"), "body_width", "font_size", "material")


def region_report(obs: DataFrame) -> DataFrame:
    """One row: regions against the body's width, multiples of the most frequent first field, the font size that follows. The
    observations are counted by first field in one pass; the rest is sums of those counts."""
    delta = F.col("width") - F.col("body_width")
    linked = F.col("font_size") > 0
    far = F.abs(delta) > 5
    ends = F.col("first") + F.col("width")
    per = stored(obs.groupBy("first").agg(
        F.count("*").alias("n"), F.count("*").alias("commands"), n_if(F.col("width") == 0).alias("zero_width"), F.count("body_width").alias("usable"), *[n_if(F.abs(delta) <= t).alias(f"within_{t}") for t in range(6)],
        n_if(far & (ends <= F.col("body_width"))).alias("far_inside"), n_if(far & (ends > F.col("body_width"))).alias("far_outside"), n_if(far & (F.col("width") > F.col("body_width"))).alias("far_wider"), n_if(far & (F.col("first") >= F.col("body_width"))).alias("far_beyond"),
        n_if(linked).alias("font_linked"),
        n_if(linked & (F.abs(F.col("first") - 1.18 * F.col("font_size")) <= 10)).alias("near_1_18_within_10"), n_if(linked & (F.abs(F.col("first") - 1.18 * F.col("font_size")) <= 20)).alias("near_1_18_within_20"),
    ))
    mode = per.agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("mode"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = [c for c in per.columns if c not in ("first", "n")]
    last = counts.index("font_linked")
    multiples = F.coalesce(F.sum(F.when((F.col("mode") > 0) & (F.col("first") % F.nullif(F.col("mode"), F.lit(0)) == 0), F.col("n"))), F.lit(0)).alias("multiples")
    return per.crossJoin(F.broadcast(mode)).agg(*map(s, counts[:last]), F.max("mode").alias("mode"), multiples, *map(s, counts[last:]))  # one row


def region_density(obs: DataFrame, widths: int = 5, multiples: int = 6, least: int = LEAST) -> DataFrame:
    """Material characters by width (the most frequent ones) and multiple of the most frequent first field. Equal observations
    are counted in one pass first."""
    obs = stored(obs.groupBy("width", "first", "material").agg(F.count("*").alias("n")))
    mode = obs.groupBy("first").agg(F.sum("n").alias("n")).agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("mode"))
    top = obs.groupBy("width").agg(F.sum("n").alias("w_n")).orderBy(F.desc("w_n"), "width").limit(widths).select("width")  # the report's own limit
    j = obs.join(F.broadcast(top), "width").crossJoin(F.broadcast(mode)).where("mode > 0 and first % mode = 0")
    j = j.withColumn("multiple", F.expr("first div mode")).where(F.col("multiple").between(1, multiples))
    return j.groupBy("width", "multiple").agg(F.sum("n").alias("n"), F.min("material").alias("low"), F.percentile("material", F.lit(0.5), F.col("n")).alias("median"), F.max("material").alias("high")).where(F.col("n") >= least)


def indent_report(commands: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: zero fields, units with indents, whether they stand before the text, beside regions and font commands."""
    w = Window.partitionBy(key, "unit")  # one unit's commands
    c = commands.withColumn("has_region", F.max(F.col("kind") == "#").over(w)).withColumn("has_font", F.max(F.col("kind") == "f").over(w)).where("kind = 'I'")
    units = c.groupBy(key, "unit").agg(F.count("*").alias("n"), *[F.count_if(F.col("values")[k] == 0).alias(f"z{k}") for k in range(4)], n_if("before_material").alias("before"), n_if("has_region").alias("region"), n_if("has_font").alias("font"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return units.agg(s("n").alias("commands"), *[s(f"z{k}").alias(f"zero_{k}") for k in range(4)], F.count("*").alias("units"), n_if(F.col("n") > 1).alias("units_with_several"), s("before").alias("before_material"), s("region").alias("with_region"), s("font").alias("with_font"))


def corpus_report(relations: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """The whole report, one row with a struct per part; every part is one row already. Of tables it needs the relations that
    have a row a table (indexes, grids, extents), and their cells."""
    i, c = relations["indexes"], relations["cells"]
    parts = {
        "row_index": index_totals(i.where("family = 'row'")), "column_index": index_totals(i.where("family = 'column'")), "coordinates": coordinate_report(relations["grids"]), "merges": merge_report(c), "tails": tail_report(relations["extents"]), "cell_fields": cell_field_report(c),
        "regions": region_report(relations["regions"]), "indents": indent_report(relations["commands"], key), "shading": distribution(c.select(F.col("fields")[5].alias("v")), "v"),
    }
    out = None
    for name, df in parts.items():
        one = df.select(F.struct("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out
