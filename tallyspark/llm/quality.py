"""Quality rules: hashed n-gram log-likelihood ratio of a text, per n-gram.

Tokens are runs of letters, marks, digits and underscores in any script, and runs of anything
else but white space (``TOKEN``, letter case kept); features are all tokens and pairs of
neighbours, hashed into ``BUCKETS`` buckets.  Two multinomials with add-one smoothing are counted over buckets: one over
trusted texts (labelled quality 1), one over every text of the corpus.  A text's score
is the mean over its features of log p_trusted - log p_raw; it is kept when the score
is ``THRESHOLD`` or more.  Base rules come first: texts of under 50 words, or of which
over half of the words stand in repeated three-word windows, are rejected.

All of it is DataFrame functions.  What a task receives is the ratio of every bucket, a
fixed number of doubles at every size (``BUCKETS``).  The trusted set is every labelled
id, one bit each in words of 64 neighbouring ids; up to ``WORDS_SENT`` words go to the texts, so
that no text is shuffled, and more are joined as Spark chooses.  Corpus counts cover all texts.  Counting is a partial aggregate, so that a hot source or a frequent
n-gram costs one row a task; scoring needs no shuffle.

A null or empty text has no words and is rejected by the base rule; with no trusted
texts at all every ratio is 0, so only the base rules decide; very long texts are read
whole; equal rows give equal rows; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: the most words of trusted ids that are broadcast
WORDS_SENT = 1 << 20
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
WHITE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words in three-word windows that the text has twice or more.

    A window's hash and its position share one long (position in the low bits, as many
    as the text's length needs), so one sort of longs brings equal windows together; windows
    with equal hashes are compared word by word.
    """
    shift = lambda f, x, n: F.call_function(f, x, n)

    def count(w: Column, n: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

        def at(bits: Column) -> Column:
            keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: shift("shiftleft", shift("shiftright", window(i), bits), bits).bitwiseOR(i.cast("long")))
            low = (F.lit(2).cast("double") ** bits).cast("long") - 1
            return let(low, lambda m: let(F.sort_array(keys), lambda s: covered(s, m, bits, w)))

        return let(F.length(F.bin(n)).cast("int"), at)

    def covered(s: Column, m: Column, bits: Column, w: Column) -> Column:
        place = lambda x: x.bitwiseAND(m).cast("int")

        def same(x: Column, y: Column) -> Column:
            words_equal = F.lit(True)
            for k in range(3):
                words_equal = words_equal & (F.get(w, place(x) + k) == F.get(w, place(y) + k))
            return F.coalesce(F.when(shift("shiftright", x, bits) == shift("shiftright", y, bits), words_equal), F.lit(False))

        hits = F.filter(s, lambda x, i: F.when((i > 0) & same(x, F.get(s, i - 1)), True).otherwise(same(x, F.get(s, i + 1))))
        places = F.sort_array(F.transform(hits, place))
        return let(places, lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)))

    return let(w, lambda v: let(F.size(v), lambda n: F.when(n < 4, F.lit(0).cast("long")).otherwise(count(v, n))))


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds w (the words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    docs = docs.withColumn("w", words(F.col("text")))
    return docs.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def buckets(text: Column, n_buckets: int = BUCKETS) -> Column:
    """Buckets of all tokens, then of all pairs of neighbouring tokens."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    one = lambda t: F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(n_buckets)).cast("int"))
    two = lambda t: F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(t, i), x), F.lit(n_buckets)).cast("int"))
    return let(tokens, lambda t: F.concat(one(t), two(t)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))


def marked(docs: DataFrame, labels: DataFrame, words_sent: int = WORDS_SENT) -> DataFrame:
    """trusted (true or null) and text of every row of docs."""
    ids, docs = trusted_ids(labels), docs.select("doc_id", "text")
    whole = ("tinyint", "smallint", "int", "bigint")
    if dict(docs.dtypes)["doc_id"] not in whole or dict(ids.dtypes)["doc_id"] not in whole:
        return docs.join(ids, "doc_id", "left").select("trusted", "text")
    word = lambda c: F.shiftright(F.col(c).cast("long"), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(c).cast("long"), F.lit(64)).cast("int"))
    masks = ids.groupBy(word("doc_id").alias("word")).agg(F.bit_or(bit("doc_id")).alias("mask"))
    if masks.limit(words_sent + 1).count() <= words_sent:
        masks = F.broadcast(masks)
    found = docs.withColumn("word", word("doc_id")).join(masks, "word", "left")
    return found.select(F.when(F.col("mask").bitwiseAND(bit("doc_id")) != 0, F.lit(True)).alias("trusted"), "text")


def fit(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS) -> list[float]:
    """log p_trusted - log p_raw of every bucket, add-one smoothed."""
    grams = marked(docs, labels).select("trusted", F.explode(buckets(F.col("text"), n_buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("trusted")).collect()  # at most n_buckets rows
    import math

    raw, trusted = sum(r.raw for r in counts), sum(r.trusted for r in counts)
    ratio = [0.0] * n_buckets
    if trusted:
        ratio = [math.log((raw + n_buckets) / (trusted + n_buckets))] * n_buckets
        for r in counts:
            ratio[r.bucket] = math.log((r.trusted + 1) / (trusted + n_buckets)) - math.log((r.raw + 1) / (raw + n_buckets))
    return ratio


def judge(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, the base counts, base_failed, n_grams, score and kept."""
    own = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id"), F.col("text"))
    row = base_counts(row)
    n = len(ratio)
    # one literal array, not n literals
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    total = let(
        buckets(F.col("text"), n),
        lambda b: F.struct(F.size(b).cast("long").alias("n"), F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(table, x)).alias("total")),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    row = row.withColumn("gram", total).withColumn("base_failed", failed)
    row = row.withColumn("score", F.when(F.col("gram.n") > 0, F.col("gram.total") / F.col("gram.n")).otherwise(0.0))
    return row.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("gram.n").alias("n_grams"), "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
