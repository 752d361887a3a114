"""Quarters, fiscal years, filing deadlines and market days as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILING_DAYS = 45


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def _parts(label: Column) -> tuple[Column, Column]:
    ok = F.when(label.rlike(r"^[0-9]{4}-Q[1-4]$"), label).otherwise(F.raise_error(F.concat(F.lit("malformed quarter label: "), F.coalesce(label, F.lit("null")))))
    return F.substring(ok, 1, 4).cast("int"), F.substring(ok, 7, 1).cast("int")


def quarter_end(label: Column) -> Column:
    """Last day of a label's quarter; a malformed label is an error."""
    y, q = _parts(label)
    return F.last_day(F.make_date(y, q * 3, F.lit(1)))


def quarter_start(label: Column) -> Column:
    y, q = _parts(label)
    return F.make_date(y, q * 3 - 2, F.lit(1))


def previous_quarter(label: Column) -> Column:
    return quarter_label(F.add_months(quarter_start(label), -3))


def last_quarters(label: Column, n: int) -> Column:
    """The label and the n - 1 before it, newest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: quarter_label(F.add_months(quarter_start(label), -3 * i)))


def filing_deadline(quarter_end_date: Column) -> Column:
    return F.date_add(quarter_end_date, FILING_DAYS)


def latest_usable_quarter(today: Column) -> Column:
    """The newest quarter whose filing deadline has passed."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.last_day(F.add_months(F.trunc(today, "quarter"), 2 - 3 * i)))
    return quarter_label(F.array_max(F.filter(ends, lambda e: filing_deadline(e) <= today)))


def quarter_phase(quarter_end_date: Column, today: Column) -> Column:
    return F.when(today <= quarter_end_date, "pre_window").when(today <= filing_deadline(quarter_end_date), "filing_window_open").otherwise("post_deadline")


def fiscal_year_end(year: Column, month: Column) -> Column:
    """Last day of the fiscal year's month; December where the month is missing or invalid."""
    m = F.when(month.between(1, 12), month).otherwise(12)
    return F.last_day(F.make_date(year, m, F.lit(1)))


def fiscal_quarter_end(year: Column, quarter: Column, months: Column) -> Column:
    """Quarter end of a fiscal year from its four month numbers in order; the last is the year's end."""
    m, end = F.get(months, quarter - 1), F.get(months, F.lit(3))
    return F.last_day(F.make_date(F.when(m <= end, year).otherwise(year - 1), m, F.lit(1)))


def quarter_nature(period_end: Column, report_date: Column) -> Column:
    return F.when(F.date_add(period_end, FILING_DAYS) <= report_date, "actual").otherwise("estimate")


def first_estimate_year(report_date: Column, end_month: Column) -> Column:
    """The fiscal year that is still open, or not yet due, at the report's date."""
    due = F.date_add(fiscal_year_end(F.year(report_date), end_month), FILING_DAYS)
    previous_due = F.date_add(fiscal_year_end(F.year(report_date) - 1, end_month), FILING_DAYS)
    return F.when(report_date < previous_due, F.year(report_date) - 1).when(report_date < due, F.year(report_date)).otherwise(F.year(report_date) + 1)


def business_day_on_or_before(d: Column) -> Column:
    """Weekends go back to Friday; holidays are not known."""
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def previous_business_day(d: Column) -> Column:
    return business_day_on_or_before(F.date_sub(d, 1))


def market_day(utc: Column) -> Column:
    """The trading day a quote at this UTC time is for: before 16:30 New York or at weekends the day before."""
    local = F.from_utc_timestamp(utc, "America/New_York")
    minutes = F.hour(local) * 60 + F.minute(local)
    day = F.to_date(local)
    return F.when((F.weekday(day) >= 5) | (minutes < 16 * 60 + 30), previous_business_day(day)).otherwise(day)


def parse_day(s: Column) -> Column:
    """M/D/YY, MM/YY (month end), Month D, YYYY, MM-DD-YYYY or ISO; null otherwise."""
    month_year = F.regexp_extract(s, r"^(\d{1,2})/(\d{2})$", 1)
    month = F.try_to_number(F.nullif(month_year, F.lit("")), F.lit("99")).cast("int")
    year = F.try_to_number(F.nullif(F.regexp_extract(s, r"^(\d{1,2})/(\d{2})$", 2), F.lit("")), F.lit("99")).cast("int") + 2000
    tries = [F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("M/d/yy", "MMMM d, yyyy", "MM-dd-yyyy", "yyyy-MM-dd")]
    return F.coalesce(F.when(month.between(1, 12), F.last_day(F.make_date(year, month, F.lit(1)))), *tries)


def age_seconds(now: Column, then: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(then)


def refresh_decision(now: Column, last_try: Column, last_bar: Column, fetched: Column) -> Column:
    """throttled within ten minutes of the last try, up_to_date with a bar of the market day, else refreshed or failed."""
    return F.when(age_seconds(now, last_try) < 600, "throttled").when(last_bar >= market_day(now), "up_to_date").when(fetched, "refreshed").otherwise("failed")
