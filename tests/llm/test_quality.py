import collections
import math
import random
import re

import duckdb
import pytest
import regex
import xxhash

from tallyspark.llm import quality

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    tri = collections.defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    covered = {j for at in tri.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def brute_features(text, n):
    t = regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_ \t\n\x0b\f\r]+", text or "")
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(h(x)) % n for x in t] + [signed(h(b, h(a))) % n for a, b in zip(t, t[1:])]


def rows():
    con = duckdb.connect()
    return con.execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a b c d", "a a a a", "a b c a b c", "x\ny\nx\n\n\n", "a\x0bb\x0cc\rd", "é é *#\n|<>&%$", "w " * 3000]
    return out + [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))) + rng.choice(["", "\n", " \n a"]) for _ in range(150)]


def test_base_counts(spark):
    texts = odd_texts() + [t for _, t in rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.base_counts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute_base(t) for i, t in enumerate(texts)}


def test_scores_equal_brute_force(spark):
    data = [*rows(), (-1, "größe Größe, naïve e\u0301tude – 漢字かな\u00a0x_1 \u2003a")]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    docs = spark.createDataFrame(data, "doc_id long, text string")
    n = 512
    raw, good = collections.Counter(), collections.Counter()
    for i, t in data:
        f = brute_features(t, n)
        raw.update(f)
        if i in trusted:
            good.update(f)
    a, b = sum(raw.values()), sum(good.values())
    want = [math.log((good[k] + 1) / (b + n)) - math.log((raw[k] + 1) / (a + n)) for k in range(n)]
    ratio = quality.fit(docs, labels, n)
    assert ratio == pytest.approx(want)
    got = {r.doc_id: r for r in quality.judge(docs, ratio).collect()}
    for i, t in data:
        f = brute_features(t, n)
        score = sum(want[x] for x in f) / len(f) if f else 0.0
        base = brute_base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert got[i].n_grams == len(f) and got[i].score == pytest.approx(score)
        assert got[i].base_failed == failed and got[i].kept == (not failed and score >= quality.THRESHOLD)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3, "k"), (None, "a b", 3, "k"), (2, "a", 3, "k"), (2, "a", 3, "k")], "doc_id long, text string, score int, kept string")
    labels = spark.createDataFrame([(None, 1), (9, 0)], "doc_id long, quality int")
    ratio = quality.fit(docs, labels)
    assert set(ratio) == {0.0}
    assert [r.kept for r in quality.judge(docs, ratio).collect()] == [False] * 4
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_plan_is_native(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    plan = quality.judge(docs, [0.0] * 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_every_trusted_label_counts(spark):
    n = 20_500
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality.trusted_ids(labels).count() == n


def test_trusted_marks_need_no_shuffle_of_texts(spark):
    ids = [None, -(1 << 63), -65, -64, -1, 0, 1, 63, 64, 65, 1 << 40, (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids + [64]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - k % 2) for k, i in enumerate(ids)] + [(64, 1), (7, 1)], "doc_id long, quality int")
    trusted = {i for k, i in enumerate(ids) if k % 2 == 0 and i is not None} | {64}
    want = sorted((f"t{i}", True if i in trusted else None) for i in ids + [64])
    for sent in (quality.WORDS_SENT, 2):
        assert sorted((r.text, r.trusted) for r in quality.marked(docs, labels, sent).collect()) == want
    texts = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert sorted((r.text, r.trusted) for r in quality.marked(texts, labels.withColumn("doc_id", labels.doc_id.cast("string"))).collect()) == want
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with labels too many for Spark's own choice
    try:
        plan = quality.marked(docs, labels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
