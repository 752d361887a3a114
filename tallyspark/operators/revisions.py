"""Tables that later events change: period corrections, manual corrections, document clean-up, merged entities.

Each is a transform from frames to frames that touches the slots or entities concerned and passes the
rest through; run again on its own result, it changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .latest import slot_winner
from .rounds import cut, survivors

# period corrections


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _ranks(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("manager", "period").orderBy(F.col("filed_at").asc_nulls_first(), "filing")
    n = F.count("*").over(Window.partitionBy("manager", "period"))
    return rows.withColumn("version_rank", F.row_number().over(w).cast("long")).withColumn("is_latest", F.col("version_rank") == n)


def corrected_periods(filings: DataFrame, covers: DataFrame) -> DataFrame:
    """Filings whose period follows their cover document, with version_rank and is_latest of both slots it touches anew.

    filings: filing, manager, period, filed_at, version_rank, is_latest; covers: filing, period (of several,
    the greatest counts; null ones don't).  Only filings of a slot (manager, period) that one was
    moved from or to are ranked again; all others keep their rows as they are.
    """
    said = covers.where("period is not null").groupBy("filing").agg(F.max("period").alias("__said"))
    rows = filings.join(said, "filing", "left").withColumn("__now", F.coalesce("__said", "period"))
    moved = rows.where(~_same("__now", "period"))
    slots = moved.select("manager", F.col("period").alias("__now")).unionByName(moved.select("manager", "__now")).distinct().withColumn("__hit", F.lit(True))
    rows = rows.join(slots, ["manager", "__now"], "left").withColumn("period", F.col("__now"))
    cols = filings.columns
    again = _ranks(rows.where("__hit")).select(*cols)
    return rows.where("__hit is null").select(*cols).unionByName(again)


_STATE = "filing long, manager long, filed_at timestamp, said_first long, said_cover long, bucket int, period long, version_rank long, is_latest boolean"


class PeriodStream:
    """The same over a stream of index and cover rows in any order; the state is a table of buckets of managers.

    events: kind (``index`` or ``cover``), filing, manager, period, filed_at.  ``apply`` takes one
    micro-batch (for foreachBatch): filings of the batch's managers are merged with it, slots that
    change are ranked anew, and only the buckets of those managers are written.  A cover that comes
    before its index waits without a rank in the bucket of its manager, so cover rows name theirs.
    A batch that is applied twice changes nothing the second time.
    """

    def __init__(self, folder: str, buckets: int = 64) -> None:
        self.folder, self.buckets = folder, buckets
        self.ranked: list[int] = []

    def table(self, spark: SparkSession) -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(_STATE).parquet(self.folder) if there else spark.createDataFrame([], _STATE)

    def filings(self, spark: SparkSession) -> DataFrame:
        return self.table(spark).where("version_rank is not null").select("filing", "manager", "period", "filed_at", "version_rank", "is_latest")

    def apply(self, batch: DataFrame, number: int = 0) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("manager"), F.lit(self.buckets)).cast("int")
        new = batch.groupBy("filing", "manager").agg(
            F.max(F.when(F.col("kind") == "index", F.col("filed_at"))).alias("filed_at"),
            F.max(F.when(F.col("kind") == "index", F.col("period"))).alias("said_first"),
            F.max(F.when(F.col("kind") == "cover", F.col("period"))).alias("said_cover"),
        )
        new = cut(new.withColumn("bucket", bucket))
        state = self.table(spark).join(new.select("bucket").distinct(), "bucket", "left_semi")
        old = state.select("filing", "manager", "filed_at", "said_first", "said_cover", "bucket", *[F.col(c).alias(f"was_{c}") for c in ("period", "version_rank", "is_latest")])
        both = old.unionByName(new, allowMissingColumns=True).groupBy("filing", "manager", "bucket").agg(
            *[F.max(c).alias(c) for c in ("filed_at", "said_first", "said_cover")], *[F.max(f"was_{c}").alias(f"was_{c}") for c in ("period", "version_rank", "is_latest")]
        )
        # without an index row a filing has no place yet
        rows = both.withColumn("period", F.when(F.col("said_first").isNotNull(), F.coalesce("said_cover", "said_first")))
        changed = rows.where(~_same("period", "was_period"))
        slots = changed.select("manager", F.col("was_period").alias("period")).unionByName(changed.select("manager", "period")).where("period is not null").distinct().withColumn("hit", F.lit(True))
        rows = rows.join(slots, ["manager", "period"], "left")
        placed = _ranks(rows.where("hit"))
        rest = rows.where("hit is null").withColumn("version_rank", F.col("was_version_rank")).withColumn("is_latest", F.col("was_is_latest"))
        cols = ["filing", "manager", "filed_at", "said_first", "said_cover", "period", "version_rank", "is_latest", "bucket"]
        out = cut(placed.select(*cols, "hit").unionByName(rest.select(*cols, "hit")))
        self.ranked.append(out.where("hit").count())
        out.drop("hit").repartition("bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.folder)


# fact logs

SLOT = ("user", "stock", "metric_key", "period_type", "period_end", "as_of")


def _slots_hit(rows: DataFrame, slots: DataFrame, slot: Sequence[str], name: str) -> DataFrame:
    """Adds a flag: the row's slot (nulls are equal) is among slots."""
    s = slots.select(*[F.col(c).alias(f"__{c}") for c in slot]).distinct().withColumn(name, F.lit(True))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in slot]
    return rows.join(s, on, "left").drop(*[f"__{c}" for c in slot]).withColumn(name, F.coalesce(name, F.lit(False)))


def corrected_facts(facts: DataFrame, corrections: DataFrame, derive: Callable[[DataFrame], DataFrame], inputs: Sequence[str], slot: Sequence[str] = SLOT) -> DataFrame:
    """The fact log after manual corrections: append-only but for is_current, with the derived facts that depend on them anew.

    facts: fact, the slot's columns, value, source_type, document, is_current; corrections: fact (the one
    corrected), new_fact (an id), value.  A correction retires its slot's current facts and adds a manual current
    one with the corrected fact's document; of two in one slot the one with the greater new_fact stays
    current.  Corrections of unknown facts do nothing.  ``derive`` gives rows like facts (calculated,
    current, without ids: null) from facts of whole (user, stock) pairs.  Derived facts of pairs with
    a corrected input (or a correction of something derived from them, as derive sees it) are
    replaced; those of all other pairs stay as they are.
    """
    known = corrections.join(facts.drop("value", "is_current", "source_type"), "fact")
    added = known.select(*[F.col("new_fact").alias("fact") if c == "fact" else F.lit("manual").alias(c) if c == "source_type" else F.lit(True).alias(c) if c == "is_current" else F.col(c) for c in facts.columns])
    added = added.join(facts.select("fact"), "fact", "left_anti")
    w = Window.partitionBy(*slot).orderBy(F.desc("fact"))
    added = cut(added.withColumn("is_current", F.row_number().over(w) == 1))
    marked = _slots_hit(facts, added, slot, "__hit").withColumn("is_current", F.col("is_current") & ~F.col("__hit")).drop("__hit")
    log = marked.unionByName(added)
    pairs = added.where(F.col("metric_key").isin(list(inputs))).select("user", "stock").distinct()
    return refreshed(log, pairs, derive)


def refreshed(log: DataFrame, pairs: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The log with the calculated facts of some (user, stock) pairs derived anew from the pairs' other facts."""
    touched = cut(log.join(pairs, ["user", "stock"], "left_semi").where("source_type != 'calculated'"))
    kept = log.join(pairs.withColumn("__again", F.lit(True)), ["user", "stock"], "left").where("__again is null or source_type != 'calculated'")
    return kept.select(*log.columns).unionByName(derive(touched).select(*log.columns))


# documents

# fixed values: states of parsing, best first
PARSE_STATES = (("parsed", 4), ("parsed_partial", 3), ("parsing", 2), ("uploaded", 2), ("failed", 1))


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """document, kept of documents to drop: those of one user, stock and report date but the best parsed, then newest, then greatest id.

    documents: document, user, stock, report_date, parse_status, uploaded; a null stock or report date is no duplicate.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PARSE_STATES for x in pair]), F.coalesce("parse_status", F.lit(""))), F.lit(0))
    w = Window.partitionBy("user", "stock", "report_date").orderBy(F.desc(rank), F.col("uploaded").desc_nulls_last(), F.desc("document"))
    rows = documents.where("stock is not null and report_date is not null")
    return rows.withColumn("kept", F.first("document").over(w)).where("document != kept").select("document", "kept", "user", "stock")


def cleaned_documents(tables: dict[str, DataFrame], derive: Callable[[DataFrame], DataFrame] | None = None, apply: bool = True, slot: Sequence[str] = SLOT) -> dict[str, DataFrame]:
    """The tables after duplicates went: one consistent step over documents, facts and whatever else names a document.

    tables: documents, facts (fact, slot, value, source_type, document, is_current) and others with a
    column document (pages, extractions).  Gives ``plan`` (document, kept), ``unmoved`` (facts that lose
    their document) and, with apply, every table anew:

    - a duplicate's parsed facts go; its other facts move to the kept document, but where that has
      another fact of the same stock, key and period they lose their document;
    - slots that lost a parsed fact are settled again: the newest report wins, a current manual fact keeps all parsed ones down;
    - calculated facts of the (user, stock) pairs concerned are derived anew;
    - other tables lose the duplicates' rows.

    The plan is the same with and without apply; on cleaned tables it is empty.
    """
    docs, facts = tables["documents"], tables["facts"]
    plan = cut(duplicate_documents(docs))
    to = plan.select("document", "kept")
    if apply:
        facts = cut(facts)  # they are read for what moves, what is lost and what stays; made once
    concerned = facts.join(to, "document")
    moving = concerned.where("source_type != 'parsed'")
    place = ["stock", "metric_key", "period_type", "period_end"]
    there = facts.join(plan.select(F.col("kept").alias("document")).distinct(), "document", "left_semi").select(*place, F.col("document").alias("kept")).distinct()
    # unlike in slots, a null place is in nobody's way
    moving = moving.join(there.withColumn("__taken", F.lit(True)), [*place, "kept"], "left")
    where_to = cut(moving.select("fact", F.when(F.col("__taken").isNull(), F.col("kept")).alias("__to"), F.lit(True).alias("__moves")))
    out = {"plan": plan, "unmoved": where_to.where("__to is null").select("fact")}
    if not apply:
        return out
    lost = cut(concerned.where("source_type = 'parsed'").select(*slot).distinct())
    rows = facts.join(where_to, "fact", "left").withColumn("document", F.when(F.col("__moves"), F.col("__to")).otherwise(F.col("document"))).drop("__to", "__moves")
    gone = to.select("document")
    rows = rows.where("source_type != 'parsed' or document is null").unionByName(rows.where("source_type = 'parsed'").join(gone, "document", "left_anti"))
    out["facts"] = settled(rows, lost, docs, slot)
    if derive is not None:
        out["facts"] = refreshed(out["facts"], plan.select("user", "stock").distinct(), derive)
    for name, t in tables.items():
        if name != "facts":
            out[name] = t.join(gone, "document", "left_anti")
    return out


def settled(facts: DataFrame, slots: DataFrame, documents: DataFrame, slot: Sequence[str] = SLOT) -> DataFrame:
    """Facts with is_current of the parsed ones of some slots settled again; facts of other slots and of other sources stay."""
    marked = _slots_hit(facts, slots, slot, "__hit")
    held = marked.where("__hit and source_type = 'manual' and is_current").select(*slot).distinct()
    parsed = marked.where("__hit and source_type = 'parsed'")
    parsed = _slots_hit(parsed, held, slot, "__held").join(documents.select("document", F.col("report_date").alias("__day")), "document", "left")
    parsed = slot_winner(parsed, slot, "__day", "document", "fact").withColumn("is_current", F.col("is_current") & ~F.col("__held"))
    rest = marked.where("not __hit or source_type != 'parsed'")
    return rest.select(*facts.columns).unionByName(parsed.select(*facts.columns))


# entities


def merged_entities(entities: DataFrame, ident: str, identities: Sequence[Sequence[str]], filled: Sequence[str], references: dict[str, tuple[DataFrame, str]], active: str = "is_active") -> dict[str, DataFrame]:
    """Active entities that share an identity become one: ``survivors`` (ident, survivor), ``entities`` and the references anew.

    identities: lists of columns; two active rows with the same non-null values of any list are the same,
    and so are chains of such rows.  The least id survives.  Columns in ``filled`` that it has null
    take the first non-null value of the others in order of id; the others become inactive.
    references: name -> (table, column): the column points to survivors; no other column changes.
    Survivors are as many as there are copies, so no join sends them through the driver.
    """
    alive = entities.where(active)
    edges = None
    for cols in identities:
        there = alive.dropna(subset=list(cols))
        first = there.hint("merge").join(there.groupBy(*cols).agg(F.min(ident).alias("b")), list(cols)).select(F.col(ident).alias("a"), "b")
        edges = first if edges is None else edges.unionByName(first)
    to = survivors(edges).select(F.col("node").alias(ident), "survivor")
    gone = to.where(F.col(ident) != F.col("survivor"))
    values = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ident))).alias(f"__{c}") for c in filled]
    spare = entities.hint("merge").join(gone, ident).groupBy(F.col("survivor").alias(ident)).agg(F.count("*").alias("__n"), *values)
    rows = entities.join(gone.withColumnRenamed("survivor", "__to").hint("merge"), ident, "left").join(spare.hint("merge"), ident, "left")
    rows = rows.withColumns({**{c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in filled}, active: F.col(active) & F.col("__to").isNull()})
    out = {"survivors": gone, "entities": rows.select(*entities.columns)}
    for name, (table, column) in references.items():
        new = table.join(gone.select(F.col(ident).alias(column), F.col("survivor").alias("__to")).hint("merge"), column, "left")
        out[name] = new.withColumn(column, F.coalesce("__to", column)).select(*table.columns)
    return out


# observations


def actual_conflicts(rows: DataFrame, slot: Sequence[str], value: str, day: str, document: str) -> DataFrame:
    """slot and the current and previous observation (value, document, day) of slots with more than one distinct value.

    Newer reports come first, a missing day last, ties by the greater document.  A slot is counted by
    its least and greatest value and ranked by its first two rows, so a hot slot is cut before the shuffle.
    """
    v = F.col(value)
    many = rows.groupBy(*slot).agg(F.min(v).alias("__low"), F.max(v).alias("__high"), F.bool_or(v.isNull()).alias("__null"))
    many = many.where(~F.col("__low").eqNullSafe(F.col("__high")) | (F.col("__null") & F.col("__low").isNotNull())).select(*slot)
    w = Window.partitionBy(*slot).orderBy(F.col(day).desc_nulls_last(), F.col(document).desc_nulls_last(), F.desc_nulls_last(v))
    two = rows.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    columns = ((value, "value"), (document, "document"), (day, "day"))
    # in the order that the rows are sorted in already: no slot's row is held in memory
    both = two.select(*slot, "__rn", *[F.col(c).alias(f"current_{k}") for c, k in columns], *[F.lead(c).over(w).alias(f"previous_{k}") for c, k in columns])
    return both.where("__rn = 1").drop("__rn").join(many, list(slot))
