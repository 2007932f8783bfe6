"""The queries opN_<name> of this subpackage, with production parameters, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontamination, language, licenses, minhash, mixing, pii, quality, secrets, toxicity, warc
from docspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = decontamination.scan(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as s
  from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct k from windows),
places as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as s
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from words, sizes where len(w) >= k)),
found as (select p.r, p.k, p.i, x.item_id from places p join windows x on x.k = p.k and x.s = p.s),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from (select distinct r, k, i from found)) group by r),
listed as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (r) left join listed using (r)
"""

QUERIES: dict[str, Query] = {"op8_toxicity": op8_toxicity, "op9_decontamination": op9_decontamination}
ORACLE_SQL: dict[str, str] = {"op9_decontamination": OP9_SQL}


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id")


QUERIES["op6_minhash"] = op6_minhash


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.allocate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with d as (
  select doc_id, source, md5(coalesce(text, '')) as key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
e as (
  select *, case when size < 2 then 0.25::double when size < 8 then 0.5::double when size < 32 then 0.75::double else 1.0::double end as w from d),
s as (
  select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from e group by source),
f as (select *, 2 * source_size::double as cap, 2 * source_size::double / weight as fill from s),
g as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from f window before as (order by fill, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap, coalesce(max(level) filter (level <= fill) over (), 'inf'::double) * weight) as target from g),
k as (select e.source, target, w, sum(size)::double as words from e join t on e.source is not distinct from t.source group by all),
c1 as (
  select *, (target - 2 * coalesce(sum(words) over (partition by source order by w desc rows between unbounded preceding and 1 preceding), 0))
    / nullif(sum(words * w) over (partition by source order by w desc rows between current row and unbounded following), 0) as c from k),
c as (select source, coalesce(max(c) filter (c * w <= 2), 'inf'::double) as c from c1 group by source),
x as (
  select e.*, t.source_size, t.target, case when size > 0 then least(2::double, c.c * w) else 0::double end as expected,
    (('0x' || substr(md5(concat_ws(':', coalesce(doc_id::varchar, '-'), key, 'mix-1')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double as u
  from e join t on e.source is not distinct from t.source join c on e.source is not distinct from c.source),
y as (select *, floor(expected)::bigint as whole, expected - floor(expected) as p from x),
z as (
  select *, target - sum(whole * size) over (partition by source) as want, (u / (1 - u)) / (p / (1 - p)) as odds from y),
o as (select *, coalesce(sum(case when p > 0 then size end) over (partition by source order by (p > 0) desc, odds, doc_id, key rows between unbounded preceding and 1 preceding), 0) as ahead from z)
select doc_id, size, source_size, target, ((whole + case when p > 0 and ahead + size / 2.0::double <= want then 1 else 0 end) * size)::bigint as taken from o
"""

QUERIES["op3_mixing"] = op3_mixing
ORACLE_SQL["op3_mixing"] = OP3_SQL


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_confirmed", "score")


QUERIES["op10_secrets"] = op10_secrets


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, name, score = language.identify(docs.select("doc_id", "text"), language.train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), F.col(name).alias("lang_pred"), F.col(score).alias("score"))


QUERIES["op7_language"] = op7_language


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES["op1_pii"] = op1_pii


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = quality.judge(docs, quality.log_ratios(docs, table(spark, sf_dir, "labels").where("quality = 1")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


QUERIES["op5_quality"] = op5_quality


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = licenses.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = out.withColumn("bases", F.filter("detections", lambda d: d["base"] == 1))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda d: d["label"]) for x in c)))), ",")
    starts = F.transform("bases", lambda d: d["start"].cast("long"))
    return out.select(
        "doc_id", "n_words", F.size("bases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("bases").alias("base_labels"), labels("bases", "kept").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["prio"])) / 100.0, F.lit(0.0)).cast("double").alias("score"),
    )


QUERIES["op4_licenses"] = op4_licenses


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive(spark, table(spark, sf_dir, "pages"))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::bigint, 5))::bigint >> (15 - i % 4 * 5)::bigint) & 31) + 1, 1)), '') as payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from p join f using (h)
"""

QUERIES["op2_warc"] = op2_warc
ORACLE_SQL["op2_warc"] = OP2_SQL
