"""The registered queries of the subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    from .graph import small_batches

    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, judge

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, _read(spark, sf_dir, "labels"))).drop("row", "n_grams")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    docs = _read(spark, sf_dir, "documents")
    model = fit(docs, _read(spark, sf_dir, "labels").where(fold("doc_id") != 0))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup

    kept = dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_near", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import decode, encode

    both = decode(encode(_read(spark, sf_dir, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove, stretches

    left = remove(stretches(_read(spark, sf_dir, "documents")))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import expand, read_back

    probe = "<|im_end|><|im_start|>assistant ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return read_back(expand(rows.unionByName(extra)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE_KINDS, KINDS, digest_column, scan

    found = scan(_read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(digest_column(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), digest_column(KINDS).alias("spans"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import classes

    return classes(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label).withColumn("rank", F.col("rank").cast("int"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import lowered, manifest

    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest(_read(spark, sf_dir, "documents"), tampered)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_KINDS, KINDS, scan

    found = scan(_read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), text(KINDS).alias("spans"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_pii": op9_pii,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secrets": op13_secrets,
}

#: the template's length: per turn its marks, role and escaped text; every reply repeats what stands before it
_OP8 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
s as (select *, 22 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 2 as chars,
  row_number() over w as i, count(*) over (partition by conv_id) as n from t window w as (partition by conv_id order by turn, role, text)),
c as (select *, sum(chars) over (partition by conv_id order by i) as upto from s)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by i)) as loss_sha256,
  cast(sum(case when role = 'assistant' or i = n then upto else 0 end) as bigint) as formatted_chars
from c group by conv_id"""

#: every anchor against every row
_OP11 = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding::double[], lambda x: floor(256 * x)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select anchor_id, positive_id, positive_score, other as negative_id, score as negative_score, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::int as rank
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3"""

#: crc32 bit by bit, then the trees level by level, then each leaf's path and fold
_OP12 = r"""
with recursive d as (select doc_id, source, lang, n_chars, text, (select count(*) from documents) as total from documents),
crc as (select doc_id, xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) as c
  from (select distinct doc_id from documents where doc_id is not null)),
f as (select d.doc_id, source, coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as fore,
    text, coalesce(c % 5 = 0, false) as touched from d left join crc using (doc_id)),
l as (select doc_id, source, sha256(fore || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(fore || coalesce(strlen(text) || ':' || case when touched then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) as present from f),
n as (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf, present) - 1 as place, count(*) over (partition by source) as size from l),
t(tree, level, place, h, size) as (select tree, 0, place, leaf, size from n union all
  select tree, level + 1, place // 16, sha256(string_agg(h, '' order by place)), (any_value(size) + 15) // 16 from t where size > 1 group by tree, level, place // 16),
r as (select tree, h as subroot, tree as place, count(*) over () as size from t where size = 1),
u(level, place, h, size) as (select 0, place, subroot, size from r union all
  select level + 1, place // 16, sha256(string_agg(h, '' order by place)), (any_value(size) + 15) // 16 from u where size > 1 group by level, place // 16),
runs as (select tree, level, place // 16 as run, list(h order by place) as hs from t where size > 1 group by tree, level, place // 16),
tops as (select level, place // 16 as run, list(h order by place) as hs from u where size > 1 group by level, place // 16),
w(id, tree, level, place, h, proof) as (select tree || ':' || place, tree, 0, place, present, '' from n union all
  select id, w.tree, w.level + 1, w.place // 16, sha256(list_aggregate(list_concat(hs[1:w.place % 16], [w.h], hs[w.place % 16 + 2:]), 'string_agg', '')),
    proof || coalesce(list_aggregate(list_concat(hs[1:w.place % 16], hs[w.place % 16 + 2:]), 'string_agg', ''), '')
  from w join runs on runs.tree = w.tree and runs.level = w.level and runs.run = w.place // 16),
ws as (select id, tree, arg_max(h, level) as h, arg_max(proof, level) as proof from w group by id, tree),
v(id, level, place, h, proof) as (select id, 0, tree, h, proof from ws union all
  select id, v.level + 1, v.place // 16, sha256(list_aggregate(list_concat(hs[1:v.place % 16], [v.h], hs[v.place % 16 + 2:]), 'string_agg', '')),
    proof || coalesce(list_aggregate(list_concat(hs[1:v.place % 16], hs[v.place % 16 + 2:]), 'string_agg', ''), '')
  from v join tops on tops.level = v.level and tops.run = v.place // 16),
vs as (select id, arg_max(h, level) as folded, arg_max(proof, level) as proof from v group by id)
select n.doc_id, n.leaf, r.subroot, u.h as root, sha256(vs.proof) as proof_sha256, vs.folded as folded_root, vs.folded = u.h as verified
from n join r using (tree) join vs on vs.id = n.tree || ':' || n.place cross join (select h from u where size = 1) u"""

ORACLES: dict[str, str] = {"op8_chat_formatting": _OP8, "op11_hard_negatives": _OP11, "op12_merkle_manifest": _OP12}
