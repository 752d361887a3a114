"""Queries over tables that later events change, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import match as MA
from tallyspark.operators import revisions as RV
from tallyspark.operators import rounds as RO

from . import analog as A
from . import sql as S
from .registry import query

# candidates

#: containment of token sets over distinct names: tokens of more than one character
_FUZZY = """lt as (select distinct l, unnest(list_distinct(list_filter(regexp_split_to_array(l, '\\s+'), lambda t: length(t) > 1))) as token, len(list_distinct(list_filter(regexp_split_to_array(l, '\\s+'), lambda t: length(t) > 1))) as ls from ln),
rt as (select distinct r, r_id, unnest(list_distinct(list_filter(regexp_split_to_array(r, '\\s+'), lambda t: length(t) > 1))) as token, len(list_distinct(list_filter(regexp_split_to_array(r, '\\s+'), lambda t: length(t) > 1))) as rs from rn),
sc as (select l, r, r_id, count(*) / least(ls, rs) as score from lt join rt using (token) group by l, r, r_id, ls, rs),
best as (select *, row_number() over (partition by l order by (l = r) desc, score desc, r, r_id) as rn from sc where l = r or score >= {least})"""


@query(f"""with ln as (select distinct p_name as l from part), rn as (select distinct lower(p_type || ' ' || p_name) as r, lower(p_type || ' ' || p_name) as r_id from part), {_FUZZY.format(least=0.5)}
select p_name as l_id, r_id, round(score, 4) as score from (select distinct p_name from part) join best on l = p_name where best.rn = 1""")
def j15_fuzzy_names_joined(spark, sf):
    p = A.table(spark, sf, "part")
    left = p.select(F.col("p_name").alias("l_id"), F.col("p_name").alias("l_name")).distinct()
    right = p.select(F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("r_name")).distinct().select(F.col("r_name").alias("r_id"), "r_name")
    return MA.fuzzy(left, right, 0.5).select("l_id", "r_id", F.round("score", 4).alias("score"))


def _names(spark, sf):
    """ident, name of parts (as managers); some names have a word more."""
    p = A.table(spark, sf, "part")
    word = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" of "), F.lower("p_brand"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit(" and"), F.lit(" sons "), F.lower("p_type"))).otherwise(F.lit(""))
    return p.select(F.col("p_partkey").alias("l_id"), F.concat("p_name", word).alias("l_name"))


@query(f"""with m as (select p_partkey as ident, p_name || case p_size % 3 when 0 then ' of ' || lower(p_brand) when 1 then ' and sons ' || lower(p_type) else '' end as l from part),
ln as (select distinct l from m), rn as (select distinct lower(p_type || ' ' || p_name) as r, lower(p_type || ' ' || p_name) as r_id from part), {_FUZZY.format(least=0.0001)},
b as (select ident, r_id as code, score from m join best using (l) where best.rn = 1),
own as (select min(p_partkey) as ident, lower(p_type || ' ' || p_name) as code from part where p_partkey % 50 = 0 group by code),
h as (select b.*, own.ident is not null and own.ident <> b.ident as held from b left join own using (code)),
f as (select *, min(case when score >= 0.85 and not held then ident end) over (partition by code) as first from h)
select ident, code, round(score, 4) as score, case when score < 0.6 then 'none' when held or coalesce(first < ident, false) then 'conflict' when score >= 0.85 then 'confirmed' else 'candidate' end as status from f""")
def j16_candidates(spark, sf):
    p = A.table(spark, sf, "part")
    code = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    right = p.select(code.alias("r_name")).distinct().select(F.col("r_name").alias("r_id"), "r_name")
    best = MA.fuzzy(_names(spark, sf), right, 0.0001).select(F.col("l_id").alias("ident"), F.col("r_id").alias("code"), "score")
    owned = p.where("p_partkey % 50 = 0").groupBy(code.alias("code")).agg(F.min("p_partkey").alias("ident"))
    return RO.settled_candidates(best, owned).withColumn("score", F.round("score", 4))


@query(f"""with recursive {S.HOLDINGS}, v as (select manager, stock, sum(shares)::bigint as n from holdings group by all),
s as (select manager, stock, n, row_number() over (order by n desc, manager, stock) as i from v),
w(i, managers, stocks, manager, stock, n) as (select 0::bigint, []::bigint[], []::varchar[], null::bigint, null::varchar, null::bigint
  union all select s.i, case when ok then list_append(managers, s.manager) else managers end, case when ok then list_append(stocks, s.stock) else stocks end, case when ok then s.manager end, case when ok then s.stock end, s.n
  from (select w.*, not list_contains(w.managers, x.manager) and not list_contains(w.stocks, x.stock) as ok from w join s x on x.i = w.i + 1) w join s on s.i = w.i + 1)
select manager, stock, n as score from w where manager is not null""")
def j16_one_to_one(spark, sf):
    pairs = A.holdings(spark, sf).groupBy(F.col("manager").alias("left"), F.col("stock").alias("right")).agg(F.sum("shares").cast("long").alias("score"))
    taken, _ = RO.one_to_one(pairs)
    return taken.select(F.col("left").alias("manager"), F.col("right").alias("stock"), "score")


# periods

_COVERS = "covers as (select l_orderkey as filing, year(max(l_shipdate)) as said from lineitem group by all)"


@query(f"""with {S.FILINGS}, {_COVERS}, n as (select manager, coalesce(said, period) as period, filed_at, filing from filings left join covers using (filing))
select filing, manager, period, row_number() over w as version_rank, row_number() over w = count(*) over (partition by manager, period) as is_latest from n window w as (partition by manager, period order by filed_at, filing)""")
def r05_period_correction(spark, sf):
    f = RV._ranks(A.filings(spark, sf).select("filing", "manager", "period", "filed_at"))
    covers = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("filing")).agg(F.year(F.max("l_shipdate")).cast("long").alias("period"))
    return RV.corrected_periods(f, covers).drop("filed_at")


# documents and facts

_DOCS = """docs as (select o_orderkey as document, o_custkey % 3 as "user", o_custkey % 40 as stock, (date_trunc('month', o_orderdate))::date as report_date, case o_orderstatus when 'F' then 'parsed' when 'O' then 'parsed_partial' else 'failed' end as parse_status, o_orderdate as uploaded from orders)"""
_LOG = f"""{_DOCS}, log as (select l_orderkey * 10 + l_linenumber as fact, "user", stock, 'm' || l_linenumber as metric_key, 'FY' as period_type, make_date(year(report_date), 12, 31) as period_end, null::date as as_of, l_quantity as value,
  case when l_returnflag = 'R' then 'manual' else 'parsed' end as source_type, document, l_returnflag = 'R' and l_linestatus = 'F' as is_current from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity, max(l_returnflag) as l_returnflag, max(l_linestatus) as l_linestatus from lineitem group by all) join docs on document = l_orderkey)"""
_PLAN = """ranked as (select document, "user", stock, first_value(document) over (partition by "user", stock, report_date order by case parse_status when 'parsed' then 4 when 'parsed_partial' then 3 when 'failed' then 1 end desc, uploaded desc, document desc) as kept from docs),
plan as (select document, kept, "user", stock from ranked where document <> kept)"""


def _docs(spark, sf):
    o = A.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "O", "parsed_partial").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("document"), (F.col("o_custkey") % 3).alias("user"), (F.col("o_custkey") % 40).alias("stock"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("report_date"), status.alias("parse_status"), F.col("o_orderdate").alias("uploaded"))


def _log(spark, sf):
    # some lines have the same key: one fact each.  Greatest letters are found by flags, since Spark sorts to aggregate strings
    def is_top(c, letter):
        return F.bool_or(F.col(c) == letter) & ~F.bool_or(F.col(c) > letter)

    lines = A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), is_top("l_returnflag", "R").alias("manual"), is_top("l_linestatus", "F").alias("closed"))
    lines = lines.join(_docs(spark, sf), F.col("document") == F.col("l_orderkey"))
    manual = F.col("manual")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), "user", "stock", F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("metric_key"), F.lit("FY").alias("period_type"),
        F.make_date(F.year("report_date"), F.lit(12), F.lit(31)).alias("period_end"), F.lit(None).cast("date").alias("as_of"), F.col("l_quantity").alias("value"),
        F.when(manual, "manual").otherwise("parsed").alias("source_type"), "document", (manual & F.col("closed")).alias("is_current"),
    )


def _cleaned(spark, sf, apply=True):
    return RV.cleaned_documents({"documents": _docs(spark, sf), "facts": _log(spark, sf), "pages": _docs(spark, sf).select("document", F.lit(1).alias("page"))}, apply=apply)


@query(f"""with {_LOG}, {_PLAN} select document, kept, (select count(*) from plan) as n from plan""")
def g06_dedupe_plan(spark, sf):
    plan = _cleaned(spark, sf, apply=False)["plan"]
    return plan.select("document", "kept").join(F.broadcast(plan.agg(F.count("*").alias("n"))), F.lit(True))


@query(f"""with {_LOG}, {_PLAN},
c as (select log.*, plan.kept from log left join plan using (document)),
taken as (select distinct stock, metric_key, period_type, period_end, document from log),
moved as (select c.* exclude (document, kept), case when kept is null then c.document when source_type = 'parsed' then c.document when t.document is null then kept end as document, kept is not null and source_type = 'parsed' as gone
  from c left join taken t on t.document = c.kept and t.stock = c.stock and t.metric_key = c.metric_key and t.period_type = c.period_type and t.period_end = c.period_end),
lost as (select distinct "user", stock, metric_key, period_type, period_end from moved where gone),
left_ as (select moved.*, lost.stock is not null as hit from moved left join lost on lost."user" = moved."user" and lost.stock = moved.stock and lost.metric_key = moved.metric_key and lost.period_end = moved.period_end where not gone),
held as (select distinct "user", stock, metric_key, period_end from left_ where hit and source_type = 'manual' and is_current),
s as (select x.*, h.stock is not null as is_held, row_number() over (partition by x."user", x.stock, x.metric_key, x.period_end, x.source_type order by report_date desc nulls last, x.document desc nulls last, fact desc) as rn
  from left_ x left join held h on h."user" = x."user" and h.stock = x.stock and h.metric_key = x.metric_key and h.period_end = x.period_end left join docs on docs.document = x.document)
select fact, document, case when hit and source_type = 'parsed' then rn = 1 and not is_held else is_current end as is_current from s""")
def g06_deduped_facts(spark, sf):
    return _cleaned(spark, sf)["facts"].select("fact", "document", "is_current")


def _ratio(pairs):
    """A derived fact of a (user, stock) pair's current facts: m1 over m2 of each year."""
    at = lambda k: F.max(F.when(F.col("metric_key") == k, F.struct("fact", "value")))["value"]
    wide = pairs.where("is_current").groupBy("user", "stock", "period_end").agg(at("m1").alias("a"), at("m2").alias("b")).where("a is not null and b > 0")
    return wide.select(
        F.lit(None).cast("long").alias("fact"), "user", "stock", F.lit("ratio").alias("metric_key"), F.lit("FY").alias("period_type"), "period_end", F.lit(None).cast("date").alias("as_of"),
        (F.col("a") / F.col("b")).alias("value"), F.lit("calculated").alias("source_type"), F.lit(None).cast("long").alias("document"), F.lit(True).alias("is_current"),
    )


@query(f"""with {_LOG}, base as (select fact, "user", stock, metric_key, period_end, value, source_type = 'parsed' or is_current as is_current from log),
k as (select fact, fact + 1000000000 as new_fact, value + 1 as value from base where fact % 7 = 0 and metric_key <> 'm3'),
a as (select new_fact as fact, b."user", b.stock, b.metric_key, b.period_end, k.value, row_number() over (partition by "user", stock, metric_key, period_end order by new_fact desc) = 1 as is_current, 'manual' as kind from k join base b using (fact)),
n as (select fact, "user", stock, metric_key, period_end, value, is_current and not exists (select 1 from a where a."user" = base."user" and a.stock = base.stock and a.metric_key = base.metric_key and a.period_end = base.period_end) as is_current, 'log' as kind from base union all select * from a),
w as (select "user", stock, period_end, arg_max(value, fact) filter (metric_key = 'm1') as a, arg_max(value, fact) filter (metric_key = 'm2') as b from n where is_current group by all)
select fact, "user", stock, metric_key, period_end, value, is_current from n union all select null, "user", stock, 'ratio', period_end, a / b, true from w where a is not null and b > 0""")
def g03_corrections(spark, sf):
    log = _log(spark, sf).withColumn("is_current", (F.col("source_type") == "parsed") | F.col("is_current"))
    facts = log.unionByName(_ratio(log))
    fixes = log.where("fact % 7 = 0 and metric_key != 'm3'").select("fact", (F.col("fact") + 1_000_000_000).alias("new_fact"), (F.col("value") + 1).alias("value"))
    return RV.corrected_facts(facts, fixes, _ratio, ["m1", "m2"]).select("fact", "user", "stock", "metric_key", "period_end", "value", "is_current")


# entities

_PARTS = """p as (select p_partkey as id, upper(p_name) as ticker, p_type || p_size as market, p_brand || p_size || p_type as listing, p_partkey % 11 <> 3 as is_active, case when p_partkey % 4 = 0 then p_brand end as exchange from part)"""


def _parts(spark, sf):
    p = A.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    return p.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("ticker"), F.concat("p_type", size).alias("market"), F.concat("p_brand", size, "p_type").alias("listing"), (F.col("p_partkey") % 11 != 3).alias("is_active"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).alias("exchange"))


_MERGE = f"""with recursive {_PARTS},
e as (select a.id as a, b.id as b from p a join p b on a.is_active and b.is_active and ((a.ticker = b.ticker and a.market = b.market) or a.listing = b.listing)),
w(a, b) as (select a, b from e union select w.a, e.b from w join e on e.a = w.b),
s as (select a as id, min(b) as survivor from w group by a having min(b) <> a)"""


@query(f"""{_MERGE} select p.id, coalesce(p.exchange, (select arg_min(q.exchange, q.id) from s join p q on q.id = s.id where s.survivor = p.id and q.exchange is not null)) as exchange, p.is_active and s.id is null as is_active, s.survivor from p left join s on s.id = p.id""")
def g14_merged_stocks(spark, sf):
    parts = _parts(spark, sf)
    out = RV.merged_entities(parts, "id", [["ticker", "market"], ["listing"]], ["exchange"], {})
    return out["entities"].join(out["survivors"].hint("merge"), "id", "left").select("id", "exchange", "is_active", "survivor")


@query(f"""{_MERGE} select coalesce(survivor, l_partkey) as stock, count(*) as n from lineitem left join s on s.id = l_partkey group by all""")
def g14_merged_references(spark, sf):
    lines = A.table(spark, sf, "lineitem")
    out = RV.merged_entities(_parts(spark, sf), "id", [["ticker", "market"], ["listing"]], ["exchange"], {"lines": (lines, "l_partkey")})
    return out["lines"].groupBy(F.col("l_partkey").alias("stock")).agg(F.count("*").alias("n"))
