"""Readers of filing indexes, holdings XML, cover pages and submission lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import issuer_name


def form_index(lines: DataFrame, forms: tuple[str, ...] = ("13F-HR", "13F-HR/A")) -> DataFrame:
    """form, company, cik (ten digits), filed, path of a quarterly index's lines (column value); bad dates and other forms are dropped.

    A record is recognised by its shape, so the header above the rule needs no line numbers.
    """
    p = r"^(\S+)\s{2,}(.*?\S)\s{2,}(\d{1,10})\s+(\d{4}-\d{2}-\d{2})\s+(\S+)\s*$"
    g = lambda i: F.regexp_extract("value", p, i)
    rows = lines.select(g(1).alias("form"), g(2).alias("company"), F.lpad(g(3), 10, "0").alias("cik"), F.try_to_timestamp(F.nullif(g(4), F.lit("")), F.lit("yyyy-MM-dd")).cast("date").alias("filed"), g(5).alias("path"))
    rows = rows.where(F.col("form").isin(*forms) & F.col("filed").isNotNull())
    return rows.withColumn("accession", F.regexp_extract("path", r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1))


_HOLDING = "infoTable array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,sshPrnamt:string,sshPrnamtType:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string,investmentDiscretion:string,votingAuthority:struct<Sole:string,Shared:string,None:string>>>"


def holdings_xml(docs: DataFrame, ident: str, xml: str) -> DataFrame:
    """ident, issuer, title, cusip, value, shares, share_type, put_call, discretion, voting_sole, voting_shared, voting_none and fingerprint of every holding of an XML column.

    Any name space prefix counts, character references are decoded, amounts may stand flat or in
    their group; a text that isn't XML gives no rows.  fingerprint is the SHA-256 of the holding's fields.
    """
    from tallyspark.functions.text import digits_only, fingerprint

    rows = docs.select(ident, F.explode(F.from_xml(xml, _HOLDING, {"ignoreNamespace": "true", "excludeAttribute": "true", "mode": "PERMISSIVE"})["infoTable"]).alias("h"))
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(f"h.{n}"), F.lit("")) for n in names])
    vote = lambda n: digits_only(tag(f"votingAuthority.{n}"))
    out = rows.select(
        ident, tag("nameOfIssuer").alias("issuer"), tag("titleOfClass").alias("title"), F.upper(tag("cusip")).alias("cusip"), digits_only(tag("value")).alias("value"), digits_only(tag("shrsOrPrnAmt.sshPrnamt", "sshPrnamt")).alias("shares"),
        tag("shrsOrPrnAmt.sshPrnamtType", "sshPrnamtType").alias("share_type"), tag("putCall").alias("put_call"), tag("investmentDiscretion").alias("discretion"), vote("Sole").alias("voting_sole"), vote("Shared").alias("voting_shared"), vote("None").alias("voting_none"),
    )
    texts = ("cusip", "issuer", "title", "share_type", "put_call", "discretion")
    numbers = ("value", "shares", "voting_sole", "voting_shared", "voting_none")
    order = ["cusip", "issuer", "title", "value", "shares", "share_type", "put_call", "discretion", "voting_sole", "voting_shared", "voting_none"]
    return out.withColumn("fingerprint", fingerprint({c: F.col(c) for c in texts}, {c: F.col(c) for c in numbers}, order))


def cover_page(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, period, form, amendment, total_value of a cover document (XML or its SGML wrapper)."""
    from tallyspark.functions.text import digits_only

    tag = lambda n: F.nullif(F.trim(F.regexp_extract(text, rf"(?is)<(?:\w+:)?{n}>(.*?)</", 1)), F.lit(""))
    sgml = F.nullif(F.regexp_extract(text, r"CONFORMED PERIOD OF REPORT:\s*(\d{8})", 1), F.lit(""))
    xml_day = F.try_to_timestamp(tag("periodOfReport"), F.lit("MM-dd-yyyy")).cast("date")
    day = F.coalesce(xml_day, F.try_to_timestamp(sgml, F.lit("yyyyMMdd")).cast("date"))
    return docs.select(ident, day.alias("period"), F.coalesce(tag("submissionType"), F.nullif(F.regexp_extract(text, r"CONFORMED SUBMISSION TYPE:\s*(\S+)", 1), F.lit(""))).alias("form"), F.lower(tag("isAmendment")).eqNullSafe(F.lit("true")).alias("amendment"), digits_only(tag("tableValueTotal")).alias("total_value"))


def submissions(docs: DataFrame, ident: str, json: str, forms: tuple[str, ...] = ("13F-HR", "13F-HR/A")) -> DataFrame:
    """ident, accession, form, filed of the parallel arrays of a submissions JSON column."""
    schema = "filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>>>"
    recent = F.from_json(json, schema)["filings"]["recent"]
    rows = docs.select(ident, F.explode(F.arrays_zip(recent["accessionNumber"].alias("accession"), recent["form"].alias("form"), recent["filingDate"].alias("filed"))).alias("x"))
    return rows.select(ident, "x.accession", "x.form", F.try_to_timestamp("x.filed", F.lit("yyyy-MM-dd")).cast("date").alias("filed")).where(F.col("form").isin(*forms))


def anchors(pages: DataFrame, ident: str, html: str, link: str) -> DataFrame:
    """ident, code, name, place of a page's anchors whose href matches ``link`` (one group: the code); a code's first one counts."""
    found = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select(ident, F.posexplode(found).alias("place", "tag"))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("tag", r"(?is)>(.*)</a>$", 1), "<[^>]*>", ""), r"^\s*-\s*", ""))
    rows = rows.select(ident, F.regexp_extract(F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1), link, 1).alias("code"), name.alias("name"), "place").where("code != ''")
    w = Window.partitionBy(ident, "code").orderBy("place")
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def with_fallback(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """The primary provider's rows and the secondary's for keys it lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys), keys, "left_anti"))


def new_content(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents (system, url, body) not stored yet, with their content's SHA-256."""
    return docs.join(stored.select("system", "url"), ["system", "url"], "left_anti").withColumn("sha256", F.sha2(F.col("body").cast("binary"), 256))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def ticker_map(docs: DataFrame, ident: str, json: str) -> DataFrame:
    """name, ticker, title of JSON maps of companies; a normal name's first entry counts, by ``ident`` and place.

    Entries without a ticker, a title or a normal name give nothing, nor do broken texts.
    """
    rows = docs.select(F.col(ident).alias("__id"), F.posexplode(F.map_values(F.from_json(json, "map<string,struct<ticker:string,title:string>>"))).alias("place", "x"))
    rows = rows.select("__id", "place", F.upper(F.trim("x.ticker")).alias("ticker"), F.trim("x.title").alias("title")).withColumn("name", issuer_name(F.col("title")))
    first = rows.where("ticker != '' and title != '' and name != ''").groupBy("name").agg(F.min(F.struct("__id", "place", "ticker", "title")).alias("x"))
    return first.select("name", "x.ticker", "x.title")
