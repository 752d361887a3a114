"""Tables that several steps need are made a fixed small number of times."""

import datetime

from tallyspark.operators import revisions as RV

DAY = datetime.date(2024, 1, 1)
DOCS = [(i, 1, 1, DAY, "parsed", datetime.datetime(2024, 1, i)) for i in (1, 2)]
FACTS = [(10 + d, 1, 1, "m", "FY", DAY, None, 1.0, "parsed", d, True) for d in (1, 2)] + [(20, 1, 1, "n", "FY", DAY, None, 2.0, "manual", 1, True)]


def test_cleaning_makes_the_facts_at_most_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def task(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "fact long, user long, stock long, metric_key string, period_type string, period_end date, as_of date, value double, source_type string, document long, is_current boolean"
    facts = spark.createDataFrame(FACTS, schema).mapInArrow(task, schema)
    docs = spark.createDataFrame(DOCS, "document long, user long, stock long, report_date date, parse_status string, uploaded timestamp")
    out = RV.cleaned_documents({"documents": docs, "facts": facts})["facts"]
    assert {(r.fact, r.document, r.is_current) for r in out.collect()} == {(12, 2, True), (20, 2, True)}
    assert seen.value <= 2 * len(FACTS)
