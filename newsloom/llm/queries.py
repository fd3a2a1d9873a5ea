"""The numbered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, caps, chat, chosen_path, dac, decontaminate, gam, langid, licenses, negatives, token_counts, warc, whitening
from .common import learn_row, table


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.hit_report(decontaminate.match_items(docs, table(spark, sf_dir, "benchmark"))).drop("longest", "longest_at")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_ids(dac.write_ids(table(spark, sf_dir, "documents"), vocabulary_path()))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.plan_records(table(spark, sf_dir, "pages"))
    return warc.read_archives(warc.write_archives(records, warc.train_dictionary(records))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs)).select("doc_id", (~learn_row()).alias("held_out"), "lang_pred", "score", "spans")


#: The planted conversation holds the control strings themselves.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    read = chat.read_chats(chat.format_chats(turns.unionByName(planted)))
    line = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = gam.score(docs, gam.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learn_row()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    n = token_counts.n_tokens(F.col("prefix_tokens"))
    return token_counts.prefix_counts(docs, words_path(), keep_text=False).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > 2048).alias("over_limit"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("anchor")))


QUERIES = {
    "op1_spherical_caps": op1_spherical_caps,
    "op2_chosen_path": op2_chosen_path,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_files": op4_token_files,
    "op5_licenses": op5_licenses,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_chat": op8_chat,
    "op9_bpe": op9_bpe,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_REACH = "r(id, c) as (select id, id from nodes union select e.b, r.c from r join e on e.a = r.id), comp as (select id, min(c) as component_id from r group by id)"

SQL = {
    "op6_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
r as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from q)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to, cast(null as varchar) as error
from r""",
    "op8_chat": """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p as (select *, lag(role) over w as before, row_number() over w as n, count(*) over (partition by conv_id) as total from c
  window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(12 + length(replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2')) + 1 + length(replace(replace(text, '~', '~0'), '<|', '~1')) + 11) as bigint) as formatted_chars,
  bool_and(case when n = 1 then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant'
    when before = 'assistant' then role = 'user' else false end) and bool_or(n = total and role = 'assistant') as valid
from p group by conv_id""",
    "op1_spherical_caps": f"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as x from embeddings
  where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
  and len(list_filter(embedding, lambda c: c <> 0)) > 0),
e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.93),
nodes as (select distinct vec_id as id from embeddings), {_REACH},
n as (select a, count(*) as n_links from e group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from embeddings left join n on n.a = vec_id left join comp on comp.id = vec_id""",
    "op2_chosen_path": f"""
with recursive w as (select doc_id, {_SPACED} as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
u as (select doc_id, unnest(s) as s from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as n from u a join u b on a.s = b.s and a.doc_id <> b.doc_id group by all),
e as (select a, b from i join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
nodes as (select distinct doc_id as id from documents), {_REACH}
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept from s left join comp on comp.id = doc_id""",
    "op3_decontaminate": f"""
with b as (select cast(item_id as varchar) as item, {_ALNUM} as w from benchmark),
win as (select item, least(10, len(w)) as n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as s from b where len(w) > 0),
sizes as (select distinct n from win),
d as (select doc_id, {_ALNUM} as w from documents),
places as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, sizes where len(w) >= n),
hits as (select doc_id, item, n, i from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from places) join win using (n, s)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as names from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op13_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
pos as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other) as int) as rank, other as negative_id, positive_score, score as negative_score
from pos join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3""",
}
