"""Documents and JSON: compare, diff, conflicts, mapping of nested reports to facts, coverage."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right of keys whose values differ or that one side lacks."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def conflicts(rows: DataFrame, slot: list[str], value: str, order: list[str]) -> DataFrame:
    """slot, n_values, observations (newest first) of slots with more than one distinct value."""
    seen = F.sort_array(F.collect_list(F.struct(*order, value)), asc=False)
    return rows.groupBy(*slot).agg(F.count_distinct(F.struct(value)).alias("n_values"), seen.alias("observations")).where("n_values > 1")


#: leaves go out in batches of so many
BATCH = 8192
_PLAIN = re.compile(r"[^.\[\]\"*]+")
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity))')
_WORDS = {"true": True, "false": False, "null": None}


def _parsed(text: str):
    """The value of a JSON text, numbers as written.  Texts too deep for the parser's own stack are read token by token."""
    try:
        return json.loads(text, parse_int=str, parse_float=str, parse_constant=str)
    except RecursionError:
        pass
    top: list = []
    stack, keys, key, at = [top], [], None, 0

    def put(v) -> None:
        if isinstance(stack[-1], dict):
            stack[-1][key] = v
        else:
            stack[-1].append(v)

    while m := _TOKEN.match(text, at):
        at, sign = m.end(), m[1]
        if sign in ("{", "["):
            new: dict | list = {} if sign == "{" else []
            put(new)
            stack.append(new)
            keys.append(key)
        elif sign in ("}", "]"):
            if isinstance(stack.pop(), dict) != (sign == "}") or not stack:
                raise ValueError(f"unbalanced JSON at {at}")
            key = keys.pop()
        elif m[2]:
            word, at = json.decoder.scanstring(text, at)
            colon = re.compile(r"\s*:").match(text, at)
            if isinstance(stack[-1], dict) and colon:
                key, at = word, colon.end()
            else:
                put(word)
        elif m[3]:
            put(_WORDS.get(m[3], m[3]))
    if text[at:].strip() or len(stack) != 1 or len(top) != 1:
        raise ValueError(f"malformed JSON at {at}")
    return top[0]


def _step(key: str) -> str:
    """A key as a step of a path: in brackets and quotes where it holds a sign of paths."""
    return key if _PLAIN.fullmatch(key) else f"[{json.dumps(key, ensure_ascii=False)}]"


def _walk(text: str) -> Iterator[tuple[str, str | None]]:
    """(path, value as written) of the leaves of one JSON text, at any depth, in document order."""
    todo = [("", _parsed(text))]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            steps = [(_step(str(k)), x) for k, x in reversed(v.items())]
            todo += [(f"{path}.{k}" if path and k[0] != "[" else path + k, x) for k, x in steps]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            yield path, str(v).lower() if isinstance(v, bool) else v


def leaves(df: DataFrame, ident: str, column: str, keep: list[str] | None = None) -> DataFrame:
    """ident, path, value (and the columns keep) of every leaf of a JSON column at any depth: objects as a.b, lists as a[0].

    A key with a sign of paths (``. [ ] " *``), or an empty one, stands as ["a.b"].  Numbers stay as written,
    true and false are words, a JSON null is a null value; of a repeated key the last counts; containers
    without leaves and null texts give no rows; a malformed text is an error.  One pass over
    the rows, without a shuffle, in batches of bounded size.
    """
    own = [ident, *(keep or [])]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ((i, *leaf) for i, text in enumerate(b.column(len(own)).to_pylist()) if text is not None for leaf in _walk(text))
            while part := list(itertools.islice(found, BATCH)):
                at, paths, values = zip(*part)
                yield pa.record_batch([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(len(own))], pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[*own, "path", "value"])

    fields = [StructField(c, df.schema[c].dataType) for c in own]
    return df.select(*own, column).mapInArrow(task, StructType([*fields, StructField("path", StringType()), StructField("value", StringType())]))


def diff(left: DataFrame, right: DataFrame, ident: str, column: str) -> DataFrame:
    """ident, path, left, right of the leaves in which two JSON columns differ."""
    a, b = leaves(left, ident, column).withColumnRenamed("value", "left"), leaves(right, ident, column).withColumnRenamed("value", "right")
    return a.join(b, [ident, "path"], "full").where(~F.col("left").eqNullSafe(F.col("right")))


#: the steps of a path as JVM and Python expressions read them
STEP = r'\["(?:[^"\\]|\\.)*"\]|\[\d*\]|[^.\[\]"]+'
#: between a shape's steps; control signs stand escaped in quoted keys and never in plain ones of a spec
_GAP = "\x01"


def steps(path: str) -> list[str]:
    """The steps of a mapping's path: ``a.b``, ``*`` any key, ``name[]`` any item, ``name[0]`` one item, ``["a.b"]`` a key with signs.

    Plain keys may hold any other signs, such as ``rate (net)`` and ``x+y``.
    """
    found = re.findall(STEP, path)
    joined = "".join(x if i == 0 or x[0] == "[" else "." + x for i, x in enumerate(found))
    if not found or joined != path:
        raise ValueError(f"path {path!r} can't be read")
    return found


def shapes(paths: Iterable[str]) -> list[tuple[int, str, str]]:
    """(number of steps, mask, shape) of each path; a mask has L for a named step, K for any key, I for any item."""
    out = []
    for p in paths:
        s = steps(p)
        mask = "".join("K" if x == "*" else "I" if x == "[]" else "L" for x in s)
        out.append((len(s), mask, _GAP.join(s)))
    return out


def shaped(leaf: DataFrame, paths: Iterable[str]) -> DataFrame:
    """Leaves with steps, mask, shape and caught (what the wildcards stood for), once for each mask of their length.

    A leaf meets the few masks of a spec, not its entries: the rest is an equi-join on mask and shape.
    """
    spark = leaf.sparkSession
    masks = sorted({(n, m) for n, m, _ in shapes(paths)})
    table = spark.createDataFrame(masks, "n_steps int, mask string")
    rows = leaf.withColumn("steps", F.regexp_extract_all("path", F.lit(STEP), F.lit(0))).withColumn("n_steps", F.size("steps"))
    rows = rows.join(F.broadcast(table), "n_steps").drop("n_steps")  # a row a mask; a shuffle would deal all leaves to a few keys
    kinds = F.split("mask", "")
    item = lambda s: s.rlike(r"^\[\d+\]$")
    general = F.zip_with("steps", kinds, lambda s, k: F.when(k == "L", s).when((k == "K") & ~item(s), "*").when((k == "I") & item(s), "[]"))
    caught = F.transform(F.filter(F.arrays_zip(F.col("steps").alias("s"), kinds.alias("k")), lambda x: x["k"] != "L"), lambda x: F.regexp_replace(x["s"], r"^\[(\d+)\]$", "$1"))
    rows = rows.withColumn("__g", general).where(~F.exists("__g", lambda x: x.isNull()))
    return rows.withColumn("shape", F.array_join("__g", _GAP)).withColumn("caught", caught).drop("__g")


def mapped(leaf: DataFrame, spec: list[dict], ident: str) -> DataFrame:
    """ident, metric_key, context, value, unit, path of the leaves that a mapping of the spec takes.

    spec: dicts of path, metric_key, unit and null_as_zero; thousands of entries are a join on the
    shapes of paths, not a test of every pattern.  context is what the first wildcard stood for.
    """
    from tallyspark.functions import numbers as N

    rows = [(mask, shape, m["metric_key"], m["unit"], bool(m.get("null_as_zero"))) for m, (_, mask, shape) in zip(spec, shapes(m["path"] for m in spec))]
    table = leaf.sparkSession.createDataFrame(rows, "mask string, shape string, metric_key string, unit string, null_as_zero boolean")
    hit = shaped(leaf, [m["path"] for m in spec]).join(F.broadcast(table), ["mask", "shape"])  # the spec: leaves have few shapes, so they aren't dealt by them
    raw = F.col("value").try_cast("double")
    number = F.when(F.col("null_as_zero"), F.coalesce(raw, F.lit(0.0))).otherwise(raw)
    return hit.select(ident, "path", "metric_key", F.get("caught", F.lit(0)).alias("context"), N.unit_value(number, F.col("unit")).alias("value"), N.base_unit(F.col("unit")).alias("unit"))


def unmapped(leaf: DataFrame, spec: list[dict]) -> DataFrame:
    """path, n: leaf paths no mapping takes, with list places and years as wildcards."""
    table = leaf.sparkSession.createDataFrame([(m, s) for _, m, s in shapes(m["path"] for m in spec)], "mask string, shape string")
    taken = shaped(leaf, [m["path"] for m in spec]).join(F.broadcast(table), ["mask", "shape"], "left_semi").select("path").distinct()
    general = F.regexp_replace(F.regexp_replace("path", r"\[\d+\]", "[]"), r"(^|\.)(19|20)\d\d(?=\.|$)", "$1*")
    return leaf.join(taken, "path", "left_anti").groupBy(general.alias("path")).agg(F.count("*").alias("n"))


def coverage(keys: DataFrame, exact: list[str], templates: list[str]) -> DataFrame:
    """metric_key, coverage: exact, templated or uncovered by a taxonomy."""
    hit = F.col("metric_key").rlike("|".join(f"(?:^{t}$)" for t in templates)) if templates else F.lit(False)
    return keys.select("metric_key", F.when(F.col("metric_key").isin(exact), "exact").when(hit, "templated").otherwise("uncovered").alias("coverage"))


def visible(owner: Column, source: Column, me: int, admins: list[int]) -> Column:
    """Parsed facts of mine or of admins; manual and calculated ones only of mine."""
    return ((source == "parsed") & owner.isin([me, *admins])) | ((owner == me) & source.isin("manual", "calculated"))


def lineage(facts: DataFrame, extractions: DataFrame) -> DataFrame:
    """fact_id, extraction: by the fact's own reference, else the newest extraction of its document and key whose period agrees or is unknown."""
    own = facts.join(extractions.select(F.col("extraction").alias("ref")), "ref", "left_semi").select("fact_id", F.col("ref").alias("extraction"))
    rest = facts.join(own.select("fact_id"), "fact_id", "left_anti")
    e = extractions.select("document", "metric_key", "extraction", F.col("period_end").alias("p"))
    agree = F.col("period_end").isNull() | F.col("p").isNull() | (F.col("period_end") == F.col("p"))
    other = rest.join(e, ["document", "metric_key"]).where(agree).groupBy("fact_id").agg(F.max("extraction").alias("extraction"))
    return own.unionByName(other)


def marked(rows: DataFrame, json_text: str, key: str, value: Column) -> DataFrame:
    """rows with ``changed``; the JSON object of ``json_text`` gets ``key`` where it lacks it or holds null.

    Other keys keep their values of any kind and stand before the new one.  A null, broken or other text becomes
    an object of that key alone; where ``value`` is null nothing changes.
    """
    old = F.from_json(json_text, "map<string,variant>")
    has = F.coalesce(F.exists(F.map_entries(old), lambda e: (e["key"] == key) & F.coalesce(F.schema_of_variant(e["value"]) != "VOID", F.lit(False))), F.lit(False))
    rest = F.coalesce(F.map_filter(old, lambda k, _: k != key), F.expr("cast(map() as map<string,variant>)"))
    changed = ~has & value.isNotNull()
    new = F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("variant"))))
    return rows.withColumns({"changed": changed, json_text: F.when(changed, new).otherwise(F.col(json_text))})
