"""Declarative mappings of nested reports to facts: loading, checking, and one plan for a whole spec.

A mapping names a node by its path (``json_path``, with ``*`` and ``name[]``), the values under
it, how its period follows from what stands around it, and what kind of fact it is.  ``facts`` walks each
document once, carries the context of list items down to the leaves, and joins leaves with mappings on
the shapes of their nodes' paths; the number of mappings is the size of a table, not of the plan.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import numbers as N

from .documents import _GAP, BATCH, STEP, _parsed, _step, shapes, steps

# fixed values
NATURES = ("actual", "estimate", "snapshot", "opinion", "mixed")
RULES = ("context_only", "context_or_annual_meta", "none")
ROLES = ("canonical_fact", "evidence_only")
DERIVATIONS = ("year_end_from_key", "year_end_from_context", "quarter_end_from_context", "financial_position_date_from_index")
DATED = ("FY", "Q", "EVENT", "AS_OF")
META = {"fiscal_month": "annual_financials.meta.fiscal_year_end_month", "estimate_years": "annual_financials.meta.estimate_years", "actual_years": "annual_financials.meta.actual_years", "historical_years": "annual_financials.meta.historical_years", "position_years": "financial_position.years"}
METRIC_KEY = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$"


class SpecError(ValueError):
    """All faults of a spec, one a line."""

    def __init__(self, faults: list[str]) -> None:
        super().__init__("\n".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Spec:
    mappings: tuple[dict, ...]


def read_text(text: str) -> dict:
    """A JSON or, where the yaml package is there, YAML text."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def compiled(spec: dict, taxonomy: dict | None = None) -> Spec:
    """The checked spec, with the taxonomy's semantics (by mapping id) in its mappings; raises ``SpecError`` with every fault."""
    import re

    faults, out, by_id = [], [], {}
    rows = spec.get("mappings")
    if not isinstance(rows, list):
        raise SpecError(["mappings is not a list"])
    for i, m in enumerate(rows):
        if not isinstance(m, dict):
            faults.append(f"mapping {i} is not an object")
            continue
        m = dict(m)
        name = m.get("id", f"#{i}")
        if isinstance(m.get("id"), str):
            if m["id"] in by_id:
                faults.append(f"mapping id {name} is repeated")
            by_id[m["id"]] = m
        out.append(m)
    semantics = (taxonomy or {}).get("mapping_semantics", {}) or {}
    for key, said in semantics.items() if isinstance(semantics, dict) else ():
        if key not in by_id:
            faults.append(f"taxonomy names the unknown mapping id {key}")
        elif not isinstance(said, dict):
            faults.append(f"taxonomy semantics of {key} are not an object")
        else:
            by_id[key].update({k: v for k, v in said.items() if v is not None and k in ("fact_nature", "fact_nature_rule", "storage_role")})
    for i, m in enumerate(out):
        name = m.get("id", f"#{i}")
        for field, allowed in (("fact_nature", NATURES), ("fact_nature_rule", RULES), ("storage_role", ROLES)):
            if m.get(field) is not None and m[field] not in allowed:
                faults.append(f"{name}: {field} {m[field]!r} is not one of {', '.join(allowed)}")
        try:
            steps(m.get("json_path") or "")
        except (ValueError, TypeError):
            faults.append(f"{name}: json_path {m.get('json_path')!r} can't be read")
        key, template = m.get("metric_key"), m.get("metric_key_template")
        if template is not None and (not isinstance(template, str) or "{metric_key}" not in template or not m.get("metric_key_from")):
            faults.append(f"{name}: metric_key_template {template!r} needs {{metric_key}} and metric_key_from")
        if template is None and (not isinstance(key, str) or not re.match(METRIC_KEY, key)):
            faults.append(f"{name}: metric_key {key!r} is not a dotted name")
        period = m.get("period_end_date") or {}
        if "derive" in period and period["derive"] not in DERIVATIONS:
            faults.append(f"{name}: period derivation {period['derive']!r} is unknown")
        value = m.get("value") or {}
        for field, path in [(f, value.get(f)) for f in ("numeric_from", "text_from")] + [("period_end_date.from", period.get("from"))]:
            if path is not None and path != "$value":
                try:
                    steps(path)
                except (ValueError, TypeError):
                    faults.append(f"{name}: {field} {path!r} can't be read")
        if not (value.get("numeric_from") or value.get("text_from")):
            faults.append(f"{name}: no value is named")
    if faults:
        raise SpecError(faults)
    return Spec(tuple(m for m in out if m.get("storage_role") != "evidence_only"))


# a walk that carries context


def _year(v) -> bool:
    return isinstance(v, str) and len(v.strip()) == 4 and v.strip().isdigit()


def _walk(text: str) -> Iterator[tuple]:
    """(path, value, calendar_year, fact_nature, period ends by step) of each leaf; what an inner list item says counts over an outer one."""
    text_of = lambda v: v if isinstance(v, str) else None
    todo = [("", _parsed(text), None, None, ())]
    while todo:
        path, v, year, nature, ends = todo.pop()
        if isinstance(v, dict):
            for k, x in reversed(v.items()):
                s = _step(str(k))
                end = text_of(x.get("period_end")) if isinstance(x, dict) else None
                todo.append((f"{path}.{s}" if path and s[0] != "[" else path + s, x, year, nature, (*ends, end)))
        elif isinstance(v, list):
            for i, x in reversed(list(enumerate(v))):
                y, n, end = year, nature, None
                if isinstance(x, dict):
                    y = text_of(x.get("calendar_year")) if "calendar_year" in x else y
                    y = x["label"] if _year(x.get("label")) else y
                    n = text_of(x.get("fact_nature")) if "fact_nature" in x else n
                    full = x.get("full_year")
                    n = text_of(full.get("fact_nature")) if isinstance(full, dict) and "fact_nature" in full else n
                    end = text_of(x.get("period_end"))
                todo.append((f"{path}[{i}]", x, y, n, (*ends, end)))
        else:
            yield path, str(v).lower() if isinstance(v, bool) else v, year, nature, list(ends)


def context_leaves(df: DataFrame, ident: str, column: str, keep: list[str]) -> DataFrame:
    """ident, keep, path, value, calendar_year, fact_nature (of the innermost list item that says so) and ends (period_end of the node at each step)."""
    own = [ident, *keep]
    names = ["path", "value", "calendar_year", "fact_nature", "ends"]
    kinds = [pa.string()] * 4 + [pa.list_(pa.string())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ((i, *leaf) for i, text in enumerate(b.column(len(own)).to_pylist()) if text is not None for leaf in _walk(text))
            while part := list(itertools.islice(found, BATCH)):
                at, *cols = zip(*part)
                yield pa.record_batch([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(len(own))], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*own, *names])

    fields = [T.StructField(c, df.schema[c].dataType) for c in own] + [T.StructField(c, T.StringType()) for c in names[:4]] + [T.StructField("ends", T.ArrayType(T.StringType()))]
    return df.select(*own, column).mapInArrow(task, T.StructType(fields))


_TABLE = "mapping int, mask string, shape string, metric_key string, unit string, period_type string, period_from string, derive string, nature string, rule string, template string, key_from string, numeric_from string, text_from string, null_as_zero boolean"


def _relative(path: str | None) -> str | None:
    return None if path is None else "" if path == "$value" else _GAP.join(steps(path))


def parsed_year(c: Column) -> Column:
    """Four digits and nothing else."""
    return F.when(c.rlike(r"^\d{4}$"), c).cast("int")


def parsed_day(c: Column) -> Column:
    """ISO days."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).try_cast("date")


def facts(df: DataFrame, ident: str, column: str, spec: Spec) -> DataFrame:
    """ident, mapping (its place in the spec), path (of the node), metric_key, value, text, unit, period_type, period_end, nature.

    A mapping's metric key may be a template, filled with a token that stands under the node (facts whose
    token isn't one of a-z, 0-9 and _ go).  A value or day is looked for under the node, then at the document's root.  A null number is 0 with
    null_as_zero.  Nodes without a value give nothing; a node without any leaf isn't seen.

    Period: the day that ``from`` names; else derived: the fiscal year's end (the month from the document's own
    data, else December) of the year in the key that ``*`` stood for or of the list item's calendar_year; the
    item's period_end; or the label at the item's index in the position table, whose four-digit years make it
    FY at the year's end.  A kind of period that needs a day and has none drops the fact.

    Nature: the mapping's own, the item's, null by rule, then for fiscal years the document's lists of
    estimates and actuals; without a list of estimates the last historical year is an estimate.
    """
    rows, rooted = [], set()
    for i, (m, (_, mask, shape)) in enumerate(zip(spec.mappings, shapes(m["json_path"] for m in spec.mappings))):
        value, period = m.get("value") or {}, m.get("period_end_date") or {}
        paths = [value.get("numeric_from"), value.get("text_from"), period.get("from")]
        rooted |= {p for p in paths if p and p != "$value"}
        numeric, text, day = map(_relative, paths)
        rows.append((i, mask, shape, m.get("metric_key"), m.get("unit"), m.get("period_type"), day, None if "from" in period else period.get("derive"), m.get("fact_nature"), m.get("fact_nature_rule"), m.get("metric_key_template"), _relative(m.get("metric_key_from")), numeric, text, bool(value.get("null_as_zero"))))
    spark = df.sparkSession
    table = spark.createDataFrame(rows, _TABLE)
    lists = {k: F.from_json(F.get_json_object(column, f"$.{p}"), "array<string>") for k, p in META.items() if k != "fiscal_month"}
    month = F.get_json_object(column, f"$.{META['fiscal_month']}").try_cast("int")
    meta = list(META)
    source = df.withColumns({**{f"__{k}": v for k, v in lists.items()}, "__fiscal_month": F.when(month.between(1, 12), month).otherwise(12)})
    leaf = context_leaves(source.select(ident, column, *[f"__{k}" for k in meta]), ident, column, [f"__{k}" for k in meta])
    leaf = leaf.withColumn("steps", F.regexp_extract_all("path", F.lit(STEP), F.lit(0)))

    # the nodes above each leaf whose shapes a mask of the spec can name
    masks = spark.createDataFrame(sorted({(len(m), m) for _, m, *_ in rows}), "n int, mask string")
    at = leaf.join(F.broadcast(masks), F.size("steps") >= F.col("n"))  # a row for each kind of path in the spec
    kinds, node = F.split("mask", ""), F.slice("steps", 1, F.col("n"))
    item = lambda s: s.rlike(r"^\[\d+\]$")
    at = at.withColumn("__g", F.zip_with(node, kinds, lambda s, k: F.when(k == "L", s).when((k == "K") & ~item(s), "*").when((k == "I") & item(s), "[]")))
    at = at.where(~F.exists("__g", lambda x: x.isNull())).withColumn("shape", F.array_join("__g", _GAP))
    hit = at.join(F.broadcast(table), ["mask", "shape"])  # the spec: leaves have few shapes, so they aren't dealt by them
    caught = F.arrays_zip(node.alias("s"), kinds.alias("k"), F.slice("ends", 1, F.col("n")).alias("e"))
    last = lambda keep, field: F.try_element_at(F.transform(F.filter(caught, keep), lambda x: x[field]), F.lit(-1))
    rest = F.array_join(F.slice("steps", F.col("n") + 1, F.size("steps")), _GAP)
    hit = hit.withColumns({
        "node": F.array_join(node, _GAP),
        "rest": rest,
        "key": last(lambda x: x["k"] == "K", "s"),
        "index": F.regexp_extract(last(lambda x: x["k"] == "I", "s"), r"(\d+)", 1).try_cast("int"),
        "end": last(lambda x: (x["k"] != "L") & x["e"].isNotNull(), "e"),
    })
    here = lambda c: F.max(F.when(F.col("rest") == F.col(c), F.col("value")))
    of = ["mapping", "metric_key", "unit", "period_type", "period_from", "derive", "nature", "rule", "template", "key_from", "numeric_from", "text_from", "null_as_zero"]
    context = ["key", "index", "end", "calendar_year", "fact_nature", *[f"__{k}" for k in meta]]
    nodes = hit.groupBy(ident, "node", *of).agg(here("numeric_from").alias("number"), here("text_from").alias("text"), here("period_from").alias("day"), here("key_from").alias("own_key"), F.first("path").alias("path"), F.first("steps").alias("steps"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in context])

    # what the document's root says, for the paths that mappings name
    if rooted:
        named = spark.createDataFrame([(_GAP.join(steps(p)),) for p in sorted(rooted)], "at string")
        roots = leaf.select(ident, F.array_join("steps", _GAP).alias("at"), "value").join(F.broadcast(named), "at")
        roots = roots.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("root"))  # at most a value a named path
        nodes = nodes.join(roots, ident, "left")
    else:
        nodes = nodes.withColumn("root", F.lit(None).cast("map<string,string>"))
    root = lambda c: F.when(F.col(c) != "", F.try_element_at("root", F.col(c)))
    raw = F.coalesce("number", root("numeric_from"))
    number = F.when(F.col("numeric_from").isNotNull(), F.when(F.col("null_as_zero"), F.coalesce(raw, F.lit("0"))).otherwise(raw)).try_cast("double")
    text, day = F.coalesce("text", root("text_from")), F.coalesce("day", root("period_from"))

    year_end = lambda y: F.when(y.isNotNull(), F.last_day(F.make_date(y, F.col("__fiscal_month"), F.lit(1))))
    label = F.get("__position_years", F.col("index"))
    plain_year = (F.length(label) == 4) & parsed_year(label).isNotNull()
    derived = (
        F.when(F.col("period_from").isNotNull(), parsed_day(day))
        .when(F.col("derive") == DERIVATIONS[0], year_end(parsed_year(F.col("key"))))
        .when(F.col("derive") == DERIVATIONS[1], year_end(parsed_year(F.col("calendar_year"))))
        .when(F.col("derive") == DERIVATIONS[2], parsed_day(F.col("end")))
        .when(F.col("derive") == DERIVATIONS[3], F.when(plain_year, F.make_date(parsed_year(label), F.lit(12), F.lit(31))).otherwise(parsed_day(label)))
    )
    kind = F.when((F.col("derive") == DERIVATIONS[3]) & plain_year, "FY").otherwise(F.col("period_type"))
    year = parsed_year(F.coalesce("key", "calendar_year"))
    among = lambda c: F.coalesce(F.array_contains(F.transform(c, lambda y: parsed_year(y)), year), F.lit(False))
    fiscal = F.col("period_type") == "FY"
    nature = (
        F.when(F.col("nature").isNotNull(), F.col("nature"))
        .when(F.col("fact_nature").isNotNull(), F.col("fact_nature"))
        .when(F.col("rule").isin("context_only", "none") | ~F.coalesce(fiscal, F.lit(False)) | year.isNull(), None)
        .when(among("__estimate_years"), "estimate")
        .when(among("__actual_years"), "actual")
        .when(F.col("__estimate_years").isNull() & (F.try_element_at("__historical_years", F.lit(-1)).try_cast("int") == year), "estimate")
    )
    unit = F.coalesce("unit", F.lit(""))
    own_key = F.trim("own_key")
    filled = F.when(own_key.rlike("^[a-z0-9_]+$"), F.replace("template", F.lit("{metric_key}"), own_key))
    nodes = nodes.withColumn("metric_key", F.when(F.col("template").isNotNull(), filled).otherwise(F.col("metric_key"))).where(F.col("metric_key").rlike(METRIC_KEY))
    out = nodes.withColumns({"__value": N.unit_value(number, unit), "__text": text, "__period": derived, "__kind": kind, "__nature": nature})
    out = out.where("__value is not null or __text is not null").where(F.col("__period").isNotNull() | ~F.coalesce(F.col("__kind").isin(*DATED), F.lit(False)))
    path = F.aggregate(F.slice("steps", 1, F.col("n")), F.lit(""), lambda a, s: F.when((a == "") | s.startswith("["), F.concat(a, s)).otherwise(F.concat(a, F.lit("."), s)))
    return out.select(ident, "mapping", path.alias("path"), "metric_key", F.col("__value").alias("value"), F.col("__text").alias("text"), F.when(F.col("__value").isNotNull(), N.base_unit(F.col("unit"))).otherwise(F.col("unit")).alias("unit"), F.col("__kind").alias("period_type"), F.col("__period").alias("period_end"), F.col("__nature").alias("nature"))
