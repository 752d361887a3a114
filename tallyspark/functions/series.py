"""Series and tables in the text of a page: runs of years, rows of values beside them, grids of columns.

All are JVM expressions over one row's text or arrays; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words for a missing number
MISSING = ("--", "NMF", "NIL")
TABLE_MISSING = (*MISSING, "NM", "N/A", "NA")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_VALUE = r"(?i)^(?:--|NMF|NIL|d?-?\d*\.?\d+%?)$"
_CELL = r"(?:--|NMF|NM|N/A|NA|NIL|[dD]?-?\d*\.?\d+)"


def flat(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def years_in(run: Column) -> Column:
    """The years 20xx of a text in order, glued ones included."""
    return F.transform(F.regexp_extract_all(run, F.lit(r"20\d{2}"), F.lit(0)), lambda y: y.cast("int"))


def year_run(text: Column, least: int = 6, gap: int = 12) -> Column:
    """The years of a text's best run, each once; an empty array without a run.

    A run is years that start at most ``gap`` characters after the one before; it counts from
    ``least`` years on.  The one with more different years wins, then more years, then the first.
    """
    # the shortest way on to the next year, taken at once: runs are cut where the gap is wider
    between = rf"20\d{{2}}(?:[\s\S]{{0,{gap - 4}}}?20\d{{2}})*+"
    found = F.transform(F.regexp_extract_all(flat(text), F.lit(between), F.lit(0)), years_in)
    runs = F.transform(F.filter(found, lambda r: F.size(r) >= least), lambda r: F.struct(F.array_distinct(r).alias("years"), F.size(r).alias("n")))
    none = F.struct(F.array().cast("array<int>").alias("years"), F.lit(0).alias("n"))
    better = lambda a, b: (F.size(b["years"]) > F.size(a["years"])) | ((F.size(b["years"]) == F.size(a["years"])) & (b["n"] > a["n"]))
    return F.aggregate(runs, none, lambda a, b: F.when(better(a, b), b).otherwise(a))["years"]


def last(values: Column, n: Column) -> Column:
    """The last n elements, all if there are fewer."""
    keep = F.least(n, F.size(values))
    return F.when(keep > 0, F.slice(values, F.size(values) - keep + 1, keep)).otherwise(F.slice(values, 1, 0))


def first(values: Column, n: Column) -> Column:
    return F.slice(values, 1, F.greatest(F.least(n, F.size(values)), F.lit(0)))


def align_years(years: Column, n_values: Column) -> Column:
    """Years for n values: all of them, those before the last for one value less, else the last ones."""
    n = F.size(years)
    return F.when(n_values == 0, F.slice(years, 1, 0)).when(n_values >= n, years).when(n_values == n - 1, first(years, n - 1)).otherwise(last(years, n_values))


def coerced(token: Column, percent: bool = False) -> Column:
    """A value's number: d or - before it is a minus, .q and .g are misread .9, missing words are null."""
    t = F.regexp_replace(F.trim(token), r"(?i)(\d+)\.[qg](\d*)", "$1.9$2")
    number = F.regexp_replace(F.regexp_replace(t, "^[dD]", ""), "%", "").try_cast("double")
    value = F.when(~F.upper(t).isin(*MISSING), F.when(t.rlike("^[dD]"), -number).otherwise(number))
    return F.when(t.endswith("%") | (F.abs(value) > 1), value / 100).otherwise(value) if percent else value


def is_value(token: Column) -> Column:
    return F.regexp_replace(token, r"(?i)(\d+)\.[qg](\d*)", "$1.9$2").rlike(_VALUE)


def labelled_series(df: DataFrame, text: str, label: str, percent: bool = False, missing_last_year: bool = False, most: int = 12, not_label: str | None = None) -> DataFrame:
    """Adds years (the last ``most`` of the text's run), series (a value a year) and projection.

    The series is the nearest row of values before the first token that matches ``label`` (a
    pattern); a value too many goes first where the row begins after another row's label, which a
    word that matches ``not_label`` (a publisher's name, say) is not.
    Fewer values than years are aligned by ``align_years``, or, with missing_last_year, from
    the first year on.  projection is the first value after the label.  Without a label the
    series is all null; without a run of years it is empty.  Rules for single page layouts
    aren't part of it.
    """
    c, n = F.col, F.size
    rows = df.withColumn("__all", year_run(F.col(text)))
    rows = rows.withColumn("years", last(c("__all"), F.lit(most))).withColumn("__t", F.split(F.trim(flat(F.col(text))), " "))
    rows = rows.withColumn("__label", F.array_position(F.transform("__t", lambda t: F.coalesce(t.rlike(f"(?i){label}"), F.lit(False))), True).cast("int"))
    before = F.reverse(first(c("__t"), c("__label") - 1))
    rows = rows.withColumn("__before", F.when(c("__label") > 0, before).otherwise(F.array().cast("array<string>")))
    flags = F.transform("__before", is_value)
    rows = rows.withColumn("__skip", F.array_position(flags, True).cast("int"))
    rows = rows.withColumn("__from", F.when(c("__skip") > 0, F.slice("__before", c("__skip"), n("__before"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("__stop", F.array_position(F.transform("__from", is_value), False).cast("int"))
    rows = rows.withColumn("__raw", F.reverse(F.when(c("__stop") > 0, first(c("__from"), c("__stop") - 1)).otherwise(c("__from"))))
    stop = F.when(c("__stop") > 0, F.get("__from", c("__stop") - 1))
    row_label = F.coalesce(stop.rlike("[A-Za-z]") & (~stop.rlike(f"(?i){not_label}") if not_label else F.lit(True)), F.lit(False))
    rows = rows.withColumn("__years", F.when((n("__all") > n("years")) & (n("__raw") > n("years")), c("__all")).otherwise(c("years")))
    spare = (n("__raw") > n("__years")) | ((n("__raw") == n("__years")) if missing_last_year else F.lit(False))
    rows = rows.withColumn("__raw", F.when(row_label & spare, last(c("__raw"), n("__raw") - 1)).otherwise(c("__raw")))
    rows = rows.withColumn("__raw", last(c("__raw"), n("__years")))
    aligned = first(c("__years"), n("__raw")) if missing_last_year else align_years(c("__years"), n("__raw"))
    rows = rows.withColumn("__aligned", aligned)
    at = lambda y: F.array_position("__aligned", y)
    value = lambda y: F.when(at(y) > 0, coerced(F.get("__raw", at(y).cast("int") - 1), percent))
    after = F.filter(F.when(c("__label") > 0, F.slice("__t", c("__label") + 1, n("__t"))).otherwise(F.array().cast("array<string>")), is_value)
    rows = rows.withColumn("series", F.transform("years", value)).withColumn("projection", F.when(n("years") > 0, coerced(F.get(after, F.lit(0)), percent)))
    return rows.drop(*[f"__{x}" for x in ("all", "t", "label", "before", "skip", "from", "stop", "raw", "years", "aligned")])


def year_map(series: Column, years: Column, projection: Column | None = None, name: str = "projection", drop_trailing_null: bool = False, keep_projection: bool = False) -> Column:
    """map of year to value of two arrays: years without a value are null, values without a year go, of a repeated year the last counts.

    drop_trailing_null takes the last year out where its value is null; the projection stands under
    ``name`` where it isn't null, or always with keep_projection.  A null series gives null.
    """
    place = F.sequence(F.lit(0), F.size(years) - 1)
    pairs = F.transform(place, lambda i: F.struct(F.get(years, i).cast("string").alias("key"), F.get(series, i).cast("double").alias("value"), i.alias("i")))
    pairs = F.when(F.size(years) > 0, pairs).otherwise(F.array().cast("array<struct<key:string,value:double,i:int>>"))
    pairs = F.filter(pairs, lambda p: ~F.array_contains(F.transform(F.slice(years, p["i"] + 2, F.size(years)), lambda y: y.cast("string")), p["key"]))
    if drop_trailing_null:
        pairs = F.filter(pairs, lambda p: ~((p["i"] == F.size(years) - 1) & p["value"].isNull()))
    out = F.transform(pairs, lambda p: F.struct(p["key"], p["value"]))
    if projection is not None:
        more = F.array(F.struct(F.lit(name).alias("key"), projection.cast("double").alias("value")))
        out = F.concat(out, more if keep_projection else F.when(projection.isNotNull(), more).otherwise(F.slice(more, 1, 0)))
    return F.when(series.isNotNull(), F.map_from_entries(out))


def group_year_maps(group: dict[str, Column], years: Column, projections: dict[str, Column] | None = None, renamed: dict[str, str] | None = None, drop_all_null: bool = False, kept: tuple[str, ...] = (), **options) -> Column:
    """map of series name to its year map; with drop_all_null, series without any value go (but those kept)."""
    entries = []
    for key, series in group.items():
        m = year_map(series, years, (projections or {}).get(key), **options)
        there = m.isNotNull()
        if drop_all_null and key not in kept:
            there = there & F.exists(F.map_values(m), lambda v: v.isNotNull())
        entries.append(F.when(there, F.struct(F.lit((renamed or {}).get(key, key)).alias("key"), m.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def column_day(header: Column) -> Column:
    """A column's header as its day: the end of a year, or m/d/yy of this century."""
    p = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    part = lambda i: F.lpad(F.regexp_extract(header, p, i), 2, "0")
    day = F.concat(F.lit("20"), part(3), F.lit("-"), part(1), F.lit("-"), part(2)).try_cast("date")
    return F.when(header.rlike(r"^\d{4}$"), F.make_date(header.try_cast("int"), F.lit(12), F.lit(31))).when(header.rlike(p), day)


def _ends(line: Column) -> Column:
    """Struct (token, end) of a line's tokens; end is the column after its last character."""
    words = F.regexp_extract_all(line, F.lit(r"(\s*)(\S+)"), F.lit(2))
    sizes = F.transform(F.regexp_extract_all(line, F.lit(r"\s*\S+"), F.lit(0)), F.length)
    upto = lambda i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b)
    return F.transform(words, lambda w, i: F.struct(w.alias("token"), upto(i).alias("end")))


HEADER = r"^(?:\d{4}|\d{1,2}/\d{1,2}/\d{2})$"


def grid(df: DataFrame, ident: str, text: str, columns: int = 3) -> DataFrame:
    """ident, line, row_label, column_label, value, state of the cells of a table in a text of lines.

    The header is the first line whose tokens end with ``columns`` years or days (m/d/yy).  A later
    line is a label and the values after it.  A full row's values stand in order; those of a
    shorter row stand in the column that ends nearest to their own end, so a gap in the middle
    stays a gap.  Words for a missing number give a null value.  state is ``ok``, or ``broken`` (one row a
    line, without a column) for a line with values but no label, more values than columns, or two in
    one column.  Lines without values are no rows; a text without a header gives none.
    """
    lines = df.select(ident, F.posexplode(F.split(text, "\n")).alias("line", "__l")).where(F.trim("__l") != "")
    lines = lines.withColumn("__t", _ends(F.col("__l")))
    tail = lambda c: last(F.col("__t"), c)
    head = F.forall(tail(F.lit(columns)), lambda t: t["token"].rlike(HEADER)) & (F.size("__t") >= columns)
    heads = lines.where(head).groupBy(ident).agg(F.min_by(F.struct("line", tail(F.lit(columns)).alias("columns")), "line").alias("__h"))
    rows = lines.join(heads, ident).where(F.col("line") > F.col("__h.line"))
    cell = lambda t: t["token"].rlike(rf"^(?:{_CELL}|[-–—])$")
    stop = F.array_position(F.transform(F.reverse("__t"), cell), False).cast("int")
    rows = rows.withColumn("__n", F.when(stop > 0, stop - 1).otherwise(F.size("__t"))).where("__n > 0")
    rows = rows.withColumn("__v", last(F.col("__t"), F.col("__n"))).withColumn("__label", F.array_join(F.transform(first(F.col("__t"), F.size("__t") - F.col("__n")), lambda t: t["token"]), " "))
    gaps = lambda t: F.transform(F.col("__h.columns"), lambda c: F.abs(c["end"] - t["end"]))
    nearest = F.transform("__v", lambda t: F.array_position(gaps(t), F.array_min(gaps(t))).cast("int") - 1)
    place = F.when(F.col("__n") == columns, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(nearest)
    rows = rows.withColumn("__place", place)
    broken = (F.col("__n") > columns) | (F.col("__label") == "") | (F.size(F.array_distinct("__place")) < F.size("__place"))
    cells = F.transform(F.arrays_zip(F.col("__v").alias("v"), F.col("__place").alias("p")), lambda x: F.struct(F.get("__h.columns", x["p"])["token"].alias("column_label"), x["v"]["token"].alias("raw"), F.lit("ok").alias("state")))
    bad = F.array(F.struct(F.lit(None).cast("string").alias("column_label"), F.lit(None).cast("string").alias("raw"), F.lit("broken").alias("state")))
    out = rows.select(ident, "line", F.col("__label").alias("row_label"), F.inline(F.when(broken, bad).otherwise(cells)))
    missing = F.upper("raw").isin(*TABLE_MISSING, "-", "–", "—")
    return out.select(ident, "line", "row_label", "column_label", F.when(~missing, coerced(F.col("raw"))).alias("value"), "state")


def month_order(text: Column) -> Column:
    """The first four different months of a quarterly header ("Mar.31 Jun.30 ..."), calendar quarters where there aren't four."""
    found = F.regexp_extract_all(F.substring(text, 1, 200), F.lit(rf"(?i)({'|'.join(MONTHS)})\.?\s*(?:\d{{1,2}}|Per)"), F.lit(1))
    months = F.slice(F.array_distinct(F.transform(found, F.initcap)), 1, 4)
    return F.when(F.size(months) == 4, months).otherwise(F.array(*map(F.lit, ("Mar", "Jun", "Sep", "Dec"))))


def quarterly(df: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, line, year, quarter (1 to 4, null for the full year), month, fiscal_year_end_month, value, state of a quarterly table.

    A row is a year, four values and perhaps a full year's; other columns after them don't count.
    The header's months name the quarters, and the last one the end of the fiscal year.  A line that
    begins with a year and at least one value but isn't such a row gives one ``broken`` row.
    """
    months = month_order(F.col(text))
    rows = df.select(ident, months.alias("__m"), F.posexplode(F.split(text, "\n")).alias("line", "__l")).where(F.col("__l").rlike(rf"^\s*\d{{4}}[ \t]+{_CELL}(?:[ \t]|$)"))
    row = rf"^\s*(\d{{4}})[ \t]+({_CELL})[ \t]+({_CELL})[ \t]+({_CELL})[ \t]+({_CELL})(?:[ \t]+({_CELL}))?(?:[ \t]+.*)?$"
    part = lambda i: F.regexp_extract("__l", row, i)
    number = lambda raw: F.when((raw != "") & ~F.upper(raw).isin(*TABLE_MISSING), coerced(raw))
    cell = lambda q: F.struct(F.lit(q).cast("int").alias("quarter"), number(part(q + 1 if q else 6)).alias("value"), F.lit("ok").alias("state"))
    full = F.when(part(6) != "", F.array(cell(None))).otherwise(F.slice(F.array(cell(None)), 1, 0))
    bad = F.array(F.struct(F.lit(None).cast("int").alias("quarter"), F.lit(None).cast("double").alias("value"), F.lit("broken").alias("state")))
    cells = F.when(F.col("__l").rlike(row), F.concat(F.array(*[cell(q) for q in (1, 2, 3, 4)]), full)).otherwise(bad)
    end = F.array_position(F.array(*map(F.lit, MONTHS)), F.get("__m", F.lit(3))).cast("int")
    year = F.regexp_extract("__l", r"^\s*(\d{4})", 1).cast("int")
    out = rows.select(ident, "line", year.alias("year"), "__m", end.alias("fiscal_year_end_month"), F.inline(cells))
    return out.select(ident, "line", "year", "quarter", F.get("__m", F.col("quarter") - 1).alias("month"), "fiscal_year_end_month", "value", "state")
