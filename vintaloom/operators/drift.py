"""Schemas that drift between files: rescue-column ingestion and a report of every change.

1. read_cells splits the text lines of each file by its own separator and quoting and names every cell.
2. enforce casts cells to the target schema (series DOUBLE, codes INT, base month); what is unknown or can't
   be cast is kept as JSON in column rescued.
3. replay gives rescued cells of approved fields their typed value by the notation they are written in.
4. schema_changes compares each file with the one before it in its feed, by the typed, rescued and replayed cells.
5. ingest does 1 to 3 and calls every field by the last name that the renames of 4 lead to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

SEPARATORS = (",", ";", "\t", "|")

# Cells that mean "no figure", and first cells of the two code lines.
EMPTY_CELLS = ("", ".", "..", "-", "na", "n/a", "nan", "null", "none", "#n/a")
TCODE_LINE = r"(?i)^transform"
GROUP_LINE = r"(?i)^group"

PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{4}$|^\d{4}[/-]\d{1,2}([/-]\d{1,2})?$|^\d{4}\.\d{1,2}\.\d{1,2}$"
FILE = ["feed_id", "vintage_month"]


def raw_cells(line: Column, sep: Column) -> Column:
    """Cells of a line as written: quotes may hold separators; a quote that is never closed counts as an ordinary sign."""

    def by(s: str) -> Column:
        q = "\\" + s if s != "\t" else s
        quoted = F.regexp_extract_all(F.concat(F.lit(s), line), F.lit(rf'{q}( *"[^"]*(?:""[^"]*)*"[^{q}]*|[^{q}]*)'), F.lit(1))
        return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, q))

    out = F.when(sep == SEPARATORS[0], by(SEPARATORS[0]))
    for s in SEPARATORS[1:]:
        out = out.when(sep == s, by(s))
    return out


def clean(cell: Column) -> Column:
    """A raw cell without outer blanks and quotes; doubled quotes inside stand for one."""
    bare = F.btrim(cell, F.lit(" \t\r\n\u00a0\"'"))
    return F.when(F.contains(cell, F.lit('""')), F.replace(bare, F.lit('""'), F.lit('"'))).otherwise(bare)


def split_cells(line: Column, sep: Column) -> Column:
    return F.transform(raw_cells(line, sep), clean)


def read_cells(lines: DataFrame) -> DataFrame:
    """Named cells: feed_id, vintage_month, kind ('tcode', 'group' or 'data'), line_no, pos, field, named, is_date, cell, key, base_month.

    A line delivered more than once counts in its latest form (received_at); blank lines and lines of
    separators only are skipped; the header is the first line left, unless it is itself a line of figures or
    codes: then the file has no header. `key` is the text of the date cell. Cells beyond the header's width,
    under an empty name, under a name that an earlier column has, or of a file without a header are not named:
    their field is # and the column's number, and empty ones are left out. Lines are parsed one by one and meet
    their file's header by a join, so a long file isn't gathered in one place.
    """
    one = (
        lines.filter("line is not null and feed_id is not null and vintage_month is not null").groupBy(*FILE, "line_no")
        .agg(F.max(F.struct("received_at", "line")).getField("line").alias("line"))
        .filter(~F.col("line").rlike(r"^[\s,;|\"'\x{FEFF}]*$"))
        .withColumn("line", F.regexp_replace("line", r"^\x{FEFF}", ""))
    )
    count = lambda s: F.length("line") - F.length(F.replace(F.col("line"), F.lit(s), F.lit("")))
    head = one.groupBy(*FILE).agg(F.min(F.struct("line_no", "line")).alias("h")).select(*FILE, F.col("h.line_no").alias("head_no"), F.col("h.line").alias("line"))
    best = F.greatest(*[F.struct(count(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)])
    head = head.withColumn("sep", best.getField("s")).withColumn("fields", split_cells(F.col("line"), F.col("sep"))).drop("line")
    absent = F.exists("fields", lambda c: c.rlike(DATE)) | F.coalesce(F.get("fields", F.lit(0)).rlike(r"(?i)^(transform|group):?$"), F.lit(False))
    head = head.withColumns({"head_no": F.when(absent, F.col("head_no") - 1).otherwise(F.col("head_no")), "fields": F.when(absent, F.array().cast("array<string>")).otherwise(F.col("fields"))})
    name = lambda f, i: F.struct(f.alias("field"), ((f != "") & (F.array_position("fields", f) == i + 1)).alias("named"))
    head = head.withColumn("names", F.transform("fields", name)).drop("fields")
    body = one.join(head, FILE).filter(F.col("line_no") > F.col("head_no")).withColumn("cells", raw_cells(F.col("line"), F.col("sep"))).drop("line", "sep")
    # the date field is the first whose cell looks like a date; in code lines it holds the line's name
    is_key = lambda c: c.rlike(f"{DATE}|{TCODE_LINE}|{GROUP_LINE}")
    body = body.withColumn("first", clean(F.get("cells", F.lit(0))))
    elsewhere = F.array_position(F.transform("cells", lambda c: is_key(clean(c))), True).cast("int") - 1
    body = body.withColumn("key_pos", F.when(is_key(F.col("first")), 0).otherwise(elsewhere))
    body = body.withColumn("key", F.when(F.col("key_pos") > 0, clean(F.get("cells", F.col("key_pos")))).otherwise(F.col("first")))
    body = body.withColumn("base_month", base_month(F.col("key")))
    body = body.withColumn("kind", F.when(F.col("key").rlike(TCODE_LINE), "tcode").when(F.col("key").rlike(GROUP_LINE), "group").otherwise("data"))
    cells = body.select(*FILE, "kind", "line_no", "key_pos", "key", "base_month", "names", F.posexplode("cells").alias("pos", "raw"))
    cells = cells.select(*FILE, "kind", "line_no", "key_pos", "key", "base_month", "pos", clean(F.col("raw")).alias("cell"), F.get("names", F.col("pos")).alias("name")).withColumn("named", F.coalesce("name.named", F.lit(False)))
    cells = cells.filter(F.col("named") | has_figure(F.col("cell"))).withColumn("field", F.when(F.col("named"), F.col("name.field")).otherwise(F.concat(F.lit("#"), F.col("pos") + 1)))
    return cells.select(*FILE, "kind", "line_no", "pos", "field", "named", (F.col("pos") == F.col("key_pos")).alias("is_date"), "cell", "key", "base_month")


def has_figure(cell: Column) -> Column:
    return cell.isNotNull() & ~F.lower(cell).isin(*EMPTY_CELLS)


def notation(cell: Column) -> Column:
    """How a cell is written: 'plain' (decimal or exponent), 'thousands', 'comma' (decimal comma) or the marks around the number."""
    return (
        F.when(~has_figure(cell), F.lit(None))
        .when(cell.rlike(PLAIN), "plain")
        .when(cell.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), "thousands")
        .when(cell.rlike(r"^[+-]?\d{1,3}(\.\d{3})*,\d+$"), "comma")
        .otherwise(F.concat(F.lit("#"), F.lower(F.regexp_replace(F.regexp_replace(cell, r"\d+([.,]\d+)*([eE][+-]?\d+)?", "9"), r"\s+", ""))))
    )


def number(cell: Column, how: Column | None = None) -> Column:
    """The figure a cell carries, without marks such as %, (p) or a unit; NULL where there is none."""
    how = notation(cell) if how is None else how
    bare = F.regexp_extract(F.regexp_replace(cell, r"\s+", ""), r"([+-]?[\d.,]*\d(?:[eE][+-]?\d+)?)", 1)
    text = F.when(how == "comma", F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    return F.when(how.isNotNull(), text.try_cast("double"))


def base_month(key: Column) -> Column:
    """yyyy-MM of a date cell written m/d/yyyy or yyyy-MM(-dd); NULL for anything else."""
    us = F.regexp_extract(key, r"^(\d{1,2})[/.-]\d{1,2}[/.-](\d{4})$", 2)
    iso = F.regexp_extract(key, r"^(\d{4})[/.-](\d{1,2})", 1)
    m_us = F.lpad(F.regexp_extract(key, r"^(\d{1,2})[/.-]", 1), 2, "0")
    m_iso = F.lpad(F.regexp_extract(key, r"^\d{4}[/.-](\d{1,2})", 1), 2, "0")
    return F.when(us != "", F.concat_ws("-", us, m_us)).when(iso != "", F.concat_ws("-", iso, m_iso))


def cast_cells(cells: DataFrame) -> DataFrame:
    """Cells of read_cells under the target schema, one row each: kind, named, is_date, cell, base_month, series, value, rescued, code.

    value is a figure cast to DOUBLE; rescued is {"series": ..., "cell": ..., "date": ...} where a figure is there but can't be
    cast, the date can't be read, or the cell isn't named (then with "column"). Cells of code lines carry their number in code; date cells carry neither.
    """
    figure = (F.col("kind") == "data") & ~F.coalesce(F.col("is_date"), F.lit(False)) & has_figure(F.col("cell"))
    code = (F.col("kind") != "data") & ~F.col("is_date")
    cells = cells.withColumn("figure", figure).withColumn("value", F.when(F.col("figure") & F.col("named") & F.col("cell").rlike(PLAIN), F.col("cell").try_cast("double")))
    lost = F.col("figure") & (F.col("value").isNull() | F.col("base_month").isNull())
    return cells.select(
        *FILE, "kind", "named", "is_date", "cell", "base_month", F.col("field").alias("series"), "value",
        F.when(lost, F.to_json(F.struct(F.col("field").alias("series"), F.col("cell"), F.col("key").alias("date"), F.when(~F.col("named"), F.col("pos") + 1).alias("column")))).alias("rescued"), F.when(code, number(F.col("cell"))).alias("code"),
    )


def enforce(lines: DataFrame) -> DataFrame:
    """One row per file, series and base month under the target schema; cells that don't fit are kept as JSON (see cast_cells).

    Columns: feed_id, vintage_month, base_month, series, tcode, macro_group, value, rescued.
    """
    return _typed(cast_cells(read_cells(lines)))


def _typed(cells: DataFrame) -> DataFrame:
    code = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("code"))).cast("int")
    codes = cells.filter("kind <> 'data' and not is_date").groupBy(*FILE, "series", "named").agg(code("tcode").alias("tcode"), code("group").alias("macro_group"))
    data = cells.filter("kind = 'data' and not coalesce(is_date, false)")
    return data.join(codes, [*FILE, "series", "named"], "left").select(*FILE, "base_month", "series", "tcode", "macro_group", "value", "rescued")


def replay(table: DataFrame, approved: Sequence[str] | Column | None = None) -> DataFrame:
    """Typed values for rescued cells of approved series (names, a condition, or None: all that are named in the header); adds notation, keeps what still can't be read in rescued."""
    allowed = F.get_json_object("rescued", "$.column").isNull() if approved is None else approved if isinstance(approved, Column) else F.col("series").isin(*approved)
    # step by step, so that no expression is worked out twice and the generated code stays small
    t = table.withColumn("_cell", F.when(F.col("rescued").isNotNull(), F.get_json_object("rescued", "$.cell"))).withColumn("_how", notation(F.col("_cell")))
    t = t.withColumn("_number", F.when(F.col("_how").isNotNull() & F.col("base_month").isNotNull() & allowed, number(F.col("_cell"), F.col("_how"))))
    return t.withColumns({
        "notation": F.when(F.col("rescued").isNotNull(), F.col("_how")).when(F.col("value").isNotNull(), "plain"),
        "value": F.coalesce("value", "_number"),
        "rescued": F.when(F.col("_how").isNull() | F.col("base_month").isNull() | ~F.coalesce(allowed, F.lit(False)) | F.coalesce("value", "_number").isNull(), F.col("rescued")),
    }).drop("_cell", "_how", "_number")


def latest_names(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """(feed_id, vintage_month, field, series): the name that each field of a file has in its feed's last file, by the renames found.

    A feed's renames, bounded by its files and fields, are applied in the order of their files.
    """
    steps = changes.filter("change_kind = 'renamed'").groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct(F.col("vintage_month").alias("at"), F.col("former_field").alias("former"), F.col("field").alias("name")))).alias("steps"))
    one = fields.select(*FILE, "field").distinct().join(steps, "feed_id", "left")
    later = F.coalesce(F.filter("steps", lambda e: e["at"] > F.col("vintage_month")), F.array().cast("array<struct<at:string,former:string,name:string>>"))
    return one.select(*FILE, "field", F.aggregate(later, F.col("field"), lambda s, e: F.when(e["former"] == s, e["name"]).otherwise(s)).alias("series"))


def ingest(lines: DataFrame, approved: Sequence[str] | None = None) -> DataFrame:
    """All files as one table of series, tcode, group and values per base month; `field` is the name in the file, series the field's last name.

    Rescued cells are replayed for approved series: those named, or by default those for which some file of
    the feed states a transformation code of 1 to 7. What isn't approved or readable stays in rescued.
    """
    cells = cut(cast_cells(read_cells(lines)))
    names = latest_names(cells.filter("named").withColumnRenamed("series", "field"), _changes(cells))
    table = _typed(cells).withColumnRenamed("series", "field").join(names, [*FILE, "field"], "left").withColumn("series", F.coalesce("series", "field"))
    if approved is None:
        coded = table.filter(F.col("tcode").between(1, 7)).select("feed_id", "series", F.lit(True).alias("_coded")).distinct()
        table = table.join(coded, ["feed_id", "series"], "left")
        done = replay(table, F.col("_coded").isNotNull() & F.get_json_object("rescued", "$.column").isNull())
    else:
        done = replay(table, approved)
    return done.select(*FILE, "base_month", "series", "field", "tcode", "macro_group", "value", "rescued", "notation")


def cell_balance(lines: DataFrame) -> DataFrame:
    """Per file: figures in its data lines, those the table holds as typed values and those it holds as rescued JSON, and the sum of the plainly written ones."""
    cells = cast_cells(read_cells(lines))
    figure = (F.col("kind") == "data") & ~F.coalesce(F.col("is_date"), F.lit(False)) & has_figure(F.col("cell"))
    return cells.groupBy(*FILE).agg(
        F.count_if(figure).alias("figures"), F.count_if(figure & F.col("rescued").isNull() & F.col("value").isNotNull()).alias("typed"), F.count_if(figure & F.col("rescued").isNotNull()).alias("rescued"),
        F.round(F.sum(F.when(figure & F.col("rescued").isNull(), F.col("value"))), 3).alias("plain_sum"),
    )


def schema_changes(lines: DataFrame, least_match: float = 0.7) -> DataFrame:
    """feed_id, vintage_month, field, change_kind, former_field of each file against the one before it in its feed.

    Cells become one row per file and field with its notation, codes and figures; each row meets the same field
    of the file before in one more aggregation. Fields present in one file only meet by the figures they carry:
    they are joined on (file pair, base month, number), so no two unrelated fields are ever paired, and a rename
    needs least_match of their common months equal. A field's notation is that of most of its figures. Fields
    without a figure or code in either file have no 'retyped', 'tcode' or 'group'. Files are ordered by
    vintage_month whatever their arrival; a feed has at most one file a month, which bounds its window.
    """
    return _changes(cast_cells(read_cells(lines)), least_match)


def _changes(typed: DataFrame, least_match: float = 0.7) -> DataFrame:
    date_how = F.regexp_replace(F.regexp_replace("cell", r"\d+", "9"), r"[^9]", "/")
    date_how = F.when(F.col("is_date"), F.concat(F.lit("@"), F.when(F.col("cell").rlike(r"^\d{4}"), "y").otherwise("m"), date_how)).otherwise(F.col("notation"))
    data = F.col("kind") == "data"
    cells = replay(typed.filter("named")).select(*FILE, F.col("series").alias("field"), "kind", "is_date", "base_month", "value", "code", F.when(data, date_how).alias("how"), ((F.col("notation") == "plain") & (F.abs("value") >= 1000)).alias("big"))
    # one exchange: both aggregations are by the columns it distributes; a file has one cell a month and field
    per_how = cells.repartition(*FILE, "field").groupBy(*FILE, "field", "how").agg(
        F.count_if(data).alias("n"), F.max(F.when(data, F.col("is_date"))).alias("is_date"), F.max("big").alias("big"),
        F.max(F.when(F.col("kind") == "tcode", F.col("code"))).alias("tcode"), F.max(F.when(F.col("kind") == "group", F.col("code"))).alias("grp"),
        F.collect_list(F.when(F.col("base_month").isNotNull() & F.col("value").isNotNull() & data, F.struct(F.col("base_month").alias("bm"), F.col("value").alias("x")))).alias("figures"),
    )
    known = F.col("how").isNotNull()
    fields = per_how.groupBy(*FILE, "field").agg(
        F.max(F.when(known, F.struct("n", "how"))).getField("how").alias("most"), F.coalesce(F.max("is_date"), F.lit(False)).alias("is_date"),
        F.max(F.when(F.col("how") == "thousands", 1).otherwise(0)).alias("thousands"), F.max("big").alias("big"), F.max("tcode").alias("tcode"), F.max("grp").alias("grp"),
        F.flatten(F.collect_list("figures")).alias("figures"),
    )
    # figures below a thousand look alike in plain and thousands notation
    how = F.when((F.col("thousands") == 1) & (F.col("most") == "plain") & ~F.coalesce(F.col("big"), F.lit(False)), "thousands").otherwise(F.col("most"))
    fields = cut(fields.select(*FILE, "field", "is_date", how.alias("how"), "tcode", "grp", "figures"))
    in_feed = W.partitionBy("feed_id").orderBy("vintage_month")
    files = fields.select(*FILE).distinct().select(*FILE, F.lead("vintage_month").over(in_feed).alias("_next"), F.lag("vintage_month").over(in_feed).isNull().alias("_first"))
    turns = F.array_compact(F.array(
        F.when(~F.col("_first"), F.struct(F.col("vintage_month").alias("at"), F.lit(True).alias("new"))),
        F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("at"), F.lit(False).alias("new"))),
    ))
    sides = fields.join(files, FILE).select("feed_id", "field", F.struct("vintage_month", "is_date", "how", "tcode", "grp").alias("p"), F.inline(turns))
    side = lambda new: F.max(F.when(F.col("new") == new, F.col("p")))
    both = cut(sides.groupBy("feed_id", "at", "field").agg(side(True).alias("n"), side(False).alias("o")))
    gone, fresh = both.filter("n is null").drop("n"), both.filter("o is null").drop("o")

    dates = gone.filter("o.is_date").select("feed_id", "at", F.col("field").alias("former"), "o").join(fresh.filter("n.is_date").select("feed_id", "at", "field", "n"), ["feed_id", "at"])
    carried = fields.select(*FILE, "field", "figures")
    lone = lambda side, s: side.filter(~F.col(f"{s}.is_date")).withColumn("vintage_month", F.col(f"{s}.vintage_month")).join(carried, [*FILE, "field"]).drop("vintage_month")
    old, new = lone(gone, "o").withColumnRenamed("field", "former"), lone(fresh, "n")
    spread = lambda df, name: df.select("feed_id", "at", name, F.inline("figures")).select("feed_id", "at", name, "bm", F.round("x", 9).alias("x")).distinct()
    same = spread(old, "former").join(spread(new, "field"), ["feed_id", "at", "bm", "x"]).groupBy("feed_id", "at", "former", "field").agg(F.count_distinct("bm").alias("same")).filter("same >= 2")
    months = lambda c: F.array_distinct(F.transform(c, lambda e: e["bm"]))
    common = (
        same.join(old.select("feed_id", "at", "former", "o", months(F.col("figures")).alias("mo")), ["feed_id", "at", "former"])
        .join(new.select("feed_id", "at", "field", "n", months(F.col("figures")).alias("mn")), ["feed_id", "at", "field"])
        .withColumn("common", F.size(F.array_intersect("mo", "mn"))).filter(F.col("same") >= least_match * F.col("common"))
    )
    score = [F.desc(F.col("same") / F.col("common")), F.desc("same"), F.asc("former"), F.asc("field")]
    place = lambda by: F.row_number().over(W.partitionBy("feed_id", "at", by).orderBy(*score))
    pairs = common.withColumns({"i": place("field"), "j": place("former")}).filter("i = 1 and j = 1")
    renamed = cut(pairs.select("feed_id", "at", "field", "former", "o", "n").unionByName(dates.select("feed_id", "at", "field", "former", "o", "n")))

    kept = both.filter("o is not null and n is not null").select("feed_id", "at", "field", F.lit("").alias("former"), "o", "n").unionByName(renamed)
    kinds = F.array_compact(F.array(
        F.when(F.col("former") != "", "renamed"), F.when(F.col("o.how") != F.col("n.how"), "retyped"),
        F.when(F.col("o.tcode") != F.col("n.tcode"), "tcode"), F.when(F.col("o.grp") != F.col("n.grp"), "group"),
    ))
    compared = kept.select("feed_id", "at", "field", "former", F.explode(kinds).alias("change_kind"))
    rest = lambda side, name, kind: side.join(renamed.select("feed_id", "at", F.col(name).alias("field")), ["feed_id", "at", "field"], "left_anti").select("feed_id", "at", "field", F.lit("").alias("former"), F.lit(kind).alias("change_kind"))
    out = compared.unionByName(rest(fresh, "field", "added")).unionByName(rest(gone, "former", "removed"))
    former = F.when(F.col("change_kind") == "renamed", F.col("former")).otherwise("")
    return out.select("feed_id", F.col("at").alias("vintage_month"), "field", "change_kind", former.alias("former_field"))
