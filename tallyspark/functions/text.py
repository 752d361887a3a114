"""Parsing and normalising of financial text as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# fixed values
SCALES = {"thousand": 1e3, "trillion": 1e12, "tril": 1e12, "billion": 1e9, "bill": 1e9, "bil": 1e9, "million": 1e6, "mill": 1e6, "mil": 1e6, "k": 1e3, "m": 1e6, "b": 1e9, "t": 1e12}
MANAGER_WORDS = ("inc", "llc", "lp", "ltd", "llp", "corp", "co", "group", "management", "capital", "advisors?", "associates?", "partners?", "holdings?", "fund", "investments?")
ISSUER_WORDS = ("inc", "corp", "co", "ltd", "llc", "lp", "plc", "nv", "ag", "sa", "the", "class [a-z]", "cl [a-z]")
EXCHANGE_ALIASES = {"NASDAQ": "NDQ", "NAS": "NDQ", "NMS": "NDQ", "NCM": "NDQ", "NGM": "NDQ", "NSDQ": "NDQ", "TSX": "TSE"}
US_EXCHANGES = ("US", "NYSE", "NASDAQ", "NDQ", "NAS", "NMS", "NCM", "NGM", "NSDQ", "AMEX", "NYSEMKT", "NYSEAMERICAN", "ARCA", "BATS", "OTC", "PNK")
CANADA_EXCHANGES = ("CA", "CAN", "TSE", "TSX", "TSXV", "CVE")

_NUMBER = r"([-+]?\d*\.?\d+)"


def _number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _NUMBER, 1), F.lit("")).try_cast("double")


def scaled(raw: Column, kind: str = "number") -> Column:
    """struct(value, unit) of a written amount: percent, currency and scale words; nulls if there is no number."""
    s = F.regexp_replace(F.replace(F.trim(F.lower(raw)), F.lit(","), F.lit("")), r"\([^)]*\)", "")
    percent = s.contains("%") | F.lit(kind == "percent")
    share = _number(F.replace(s, F.lit("%"), F.lit(""))) / 100.0
    bare = F.replace(s, F.lit("$"), F.lit(""))
    pattern = rf"({'|'.join(SCALES)})\.?\b"
    token = F.regexp_extract(bare, pattern, 1)
    factor = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), lambda k, v: k == token)), F.lit(0)), F.lit(1.0))
    # only the first scale word goes
    at = F.regexp_instr(bare, F.lit(pattern))
    full = F.regexp_extract(bare, pattern, 0)
    rest = F.when(at > 0, F.concat(F.substring(bare, F.lit(1), at - 1), F.substring(bare, at + F.length(full), F.length(bare)))).otherwise(bare)
    value = _number(rest) * factor
    unit = F.lit("ratio") if kind == "ratio" else F.when(s.contains("$") | F.lit(kind == "currency"), "USD").otherwise("number")
    v = F.when(percent, share).otherwise(value)
    return F.struct(v.alias("value"), F.when(v.isNotNull(), F.when(percent, "ratio").otherwise(unit)).alias("unit"))


def accounting_number(raw: Column) -> Column:
    """Written statement figures: d, parentheses or minus make it negative; NMF, -- and Nil are null."""
    s = F.replace(F.replace(F.trim(raw), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    none = F.upper(s).isin("NMF", "--", "NIL", "NA", "") | s.isNull()
    negative = s.rlike(r"^d") | s.rlike(r"^\(.*\)$") | s.rlike(r"^-")
    digits = F.regexp_replace(F.regexp_replace(s, r"^[d(-]+|[)%]+$", ""), r"\.q", ".9")
    number = F.regexp_replace(digits, r"^\.", "0.").try_cast("double")
    return F.when(~none, F.when(negative, -number).otherwise(number))


def plain(name: Column, stop_words: tuple[str, ...]) -> Column:
    """Lower case without stop words (patterns), punctuation and repeated spaces."""
    s = F.regexp_replace(F.lower(name), rf"\b({'|'.join(stop_words)})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """Accents taken off (compatibility decomposition, ASCII only)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def manager_name(name: Column) -> Column:
    return plain(folded(name), MANAGER_WORDS)


def issuer_name(name: Column) -> Column:
    return plain(name, ISSUER_WORDS)


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: F.length(t) > 1))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; 0 where one is empty."""
    x, y = name_tokens(a), name_tokens(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small > 0, F.size(F.array_intersect(x, y)) / small).otherwise(F.lit(0.0))


def digits_only(c: Column) -> Column:
    """All digits as one number (signs and points go); null without any."""
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).cast("long")


def marked(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(c)), F.lit("")), F.lit("__NULL__"))


def fingerprint(texts: dict[str, Column], numbers: dict[str, Column], order: list[str]) -> Column:
    """SHA-256 of fields joined by bars: texts trimmed and upper-cased, missing ones marked, missing numbers 0."""
    parts = [marked(texts[k]) if k in texts else F.coalesce(numbers[k].cast("string"), F.lit("0")) for k in order]
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def company_part(name: Column) -> Column:
    """What follows " - " in "person - company"; the name itself without it."""
    return F.when(name.contains(" - "), F.trim(F.regexp_extract(name, r"^.*? - (.*)$", 1))).otherwise(F.trim(name))


def name_and_cik(s: Column) -> Column:
    """struct(name, cik) of "Name (CIK n)", zero-padded to ten digits."""
    cik = F.regexp_extract(s, r"\(CIK\s*(\d+)\)", 1)
    return F.struct(F.trim(F.regexp_replace(s, r"\s*\(CIK\s*\d+\).*$", "")).alias("name"), F.when(cik != "", F.lpad(cik, 10, "0")).alias("cik"))


def listing_exchange(x: Column) -> Column:
    u = F.nullif(F.upper(F.trim(x)), F.lit(""))
    return F.coalesce(*[F.when(u == k, F.lit(v)) for k, v in EXCHANGE_ALIASES.items()], u)


def market_country(x: Column, ticker: Column) -> Column:
    e = listing_exchange(x)
    return F.when(F.upper(ticker).endswith(".TO"), "CA").when(e.isin(*CANADA_EXCHANGES), "CA").when(e.isin(*US_EXCHANGES), "US").otherwise(F.coalesce(e, F.lit("UNKNOWN")))


def rating_event(note: Column) -> Column:
    """struct(kind, day) of "Raised 6/9/23" style notes."""
    kind = F.lower(F.regexp_extract(note, r"(?i)(raised|lowered|new|suspended)", 1))
    day = F.try_to_timestamp(F.regexp_extract(note, r"(\d{1,2}/\d{1,2}/\d{2})", 1), F.lit("M/d/yy")).cast("date")
    return F.struct(F.nullif(kind, F.lit("")).alias("kind"), day.alias("day"))


def between_anchors(text: Column, start: str, end: str) -> Column:
    """The shortest stretch from after ``start`` to before ``end`` (patterns); null if missing."""
    return F.nullif(F.regexp_extract(text, f"(?s){start}(.*?){end}", 1), F.lit(""))


def label_of(key: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(key, r"^.*\.", ""), "_", " "))


def value_kind(key: Column, unit: Column) -> Column:
    return F.when(unit.isin("ratio", "percent") | key.rlike("margin|yield|return|ratio"), "percent").when(key.contains("shares"), "shares").when(unit == "USD", "currency").when(key.startswith("rating."), "rating").otherwise("number")


def review_group(key: Column) -> Column:
    """Review section of a metric key, by ordered token rules."""
    rules = [("rating|quality", "ratings"), ("target|proj", "targets"), ("^is\\.|sales|income|margin", "income"), ("^bs\\.|asset|liabilit|equity", "balance"), ("cap\\.|debt", "capital"), ("per_share", "per_share"), ("val\\.|yield|pe$", "valuation")]
    c = F.when(key.rlike(rules[0][0]), rules[0][1])
    for pattern, group in rules[1:]:
        c = c.when(key.rlike(pattern), group)
    return c.otherwise("other")


def percent_label(c: Column) -> Column:
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def money_label(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))
