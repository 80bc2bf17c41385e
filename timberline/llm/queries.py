"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import conversation_repair, exact_dedup, html_extract, line_dedup, lm_score, mixing, near_dup, online_packing, packing, phrases, quality, shard, token_output

#: Mixing weights of the query and the pipeline: domains, languages within a domain; sources of a language weigh the same.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "forums": 0.2}
LANGUAGE_WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


#: Boilerplate rule of the query and the pipeline: sites of any size; a line on three pages of its own, copies of a page being one.
SITE_RULE = {"min_pages": 1, "min_count": 3, "copies_once": True}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: Column) -> Column:
    """These tables name no domain; it follows from the source's number."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.element_at(F.array(*(F.lit(d) for d in DOMAIN_WEIGHTS)), F.coalesce(F.pmod(number, F.lit(3)), F.lit(0)) + 1)


def weight_of(path: mixing.Path) -> float:
    if len(path) == 1:
        return DOMAIN_WEIGHTS.get(path[0], 0.05)
    if len(path) == 2:
        return LANGUAGE_WEIGHTS.get(path[1], 0.05)
    return 1.0


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix_sources(docs, {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}, weight_of)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign_shards(table(spark, sf_dir, "documents"), shards=40)


def op3_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, f"timberline_digests_{uuid.uuid4().hex}")
    # two batches, the larger ids first, since the index keeps what came first and the largest id is to stay
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    newer = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    out = index.deduplicate_batches([docs.filter(newer), docs.filter(~newer)])
    index.drop()  # the query's own; what it returns reads the staged verdicts
    return out


def op4_bloom_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return lm_score.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture(docs).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__n_tokens").alias("n_tokens"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), F.col("source"), report=True, **SITE_RULE)
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.join(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(quality.mask_of("base"))) != 0)
    return quality.with_verdict(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("failed").alias("failed_rules"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_online(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a checksum of their key: ``here`` is false for dropped rows."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("here"), F.when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("time", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times", "time")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), present=F.col("here")).summary()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_bounded_ring_sharding, op3_digest_index_dedup, op4_bloom_lm_scoring, op5_source_mixing, op6_line_dedup, op7_best_two_fit_packing, op8_ngram_jaccard_join, op9_token_output, op10_quality_rules, op11_phrase_collocations, op12_online_packing, op13_conversation_repair, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for operators 3, 6, 10 and 11. The others hash, tokenize, learn or search; tests hold them to brute force."""
    return {"op3_digest_index_dedup": OP3_SQL, "op6_line_dedup": OP6_SQL, "op10_quality_rules": OP10_SQL, "op11_phrase_collocations": OP11_SQL}


OP3_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""

OP6_SQL = r"""
with p as (select row_number() over () as page, doc_id, source, text from documents),
l as (
  select page, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as k from p where text is not null
),
b as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as bare from l),
own as (select page, source, coalesce(list_sort(list_distinct(list(bare) filter (where bare <> ''))), []) as lines from b right join p using (page, source) group by page, source),
sets as (select distinct source, lines from own),
pages as (select source, count(*) as pages from sets group by source),
common as (
  select s.source, bare from (select source, unnest(lines) as bare from sets) s join pages g on s.source is not distinct from g.source
  group by s.source, bare having count(*) > 0.08 * any_value(pages) and count(*) >= 3
),
kept as (
  select b.page, count(*) filter (where b.bare <> '') as n_lines, count(*) filter (where c.bare is not null) as n_dropped,
         coalesce(string_agg(b.line, chr(10) order by b.k) filter (where c.bare is null), '') as text
  from b left join common c on b.source is not distinct from c.source and b.bare = c.bare group by b.page
)
select p.doc_id, p.source, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_dropped, 0) as n_dropped, length(k.text) as n_chars, md5(k.text) as text_md5
from p left join kept k using (page)
"""

OP10_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (
  select r, k, hash as h from (
    select r, unnest(range(1, len(ws) - 1)) as k, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as hash from w where len(ws) >= 3
  )
),
again as (select r, k from (select r, k, count(*) over (partition by r, h) as n from g) where n > 1),
rep as (select r, count(distinct p) as n_repeat_words from (select r, unnest([k, k + 1, k + 2]) as p from again) group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (length(t) - length(replace(t, '!', '')))::bigint as n_exclamations,
         coalesce(l.n_lines, 0) as n_lines, coalesce(l.n_dup_lines, 0) as n_dup_lines, coalesce(rep.n_repeat_words, 0) as n_repeat_words
  from w left join l using (r) left join rep using (r)
),
f as (
  select *, ((n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int
    + 8 * (10 * n_dup_lines > 3 * n_lines)::int + 16 * (word_chars < 3 * n_words)::int + 32 * (word_chars > 12 * n_words)::int
    + 64 * (10 * n_exclamations > 3 * n_words)::int + 128 * (2 * n_dup_lines > n_lines)::int)::int as failed_rules
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 as base_failed, (failed_rules & 247) = 0 as kept, failed_rules from f
"""

OP11_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
one as (select lang, unnest(ws) as x from w),
f1 as (select lang, x, count(*) as f from one group by lang, x),
sizes as (select lang, sum(f)::bigint as n from f1 group by lang),
two as (select lang, unnest(list_transform(range(1, len(ws)), lambda i: {'x': ws[i], 'y': ws[i + 1]})) as t from w where len(ws) > 1),
f2 as (select lang, t.x as x, t.y as y, count(*) as f from two group by lang, t.x, t.y having count(*) >= 10),
three as (select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'x': ws[i], 'y': ws[i + 1], 'z': ws[i + 2]})) as t from w where len(ws) > 2),
f3 as (select lang, t.x as x, t.y as y, t.z as z, count(*) as f from three group by lang, t.x, t.y, t.z having count(*) >= 10),
inside as (
  select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) group by lang, x, y
),
c2 as (
  select p.lang, p.x || ' ' || p.y as phrase, p.f as a, l.f as l, r.f as r, (1000000::hugeint * p.f * p.f) // (l.f::hugeint * r.f) as score
  from f2 p join f1 l on p.lang = l.lang and p.x = l.x join f1 r on p.lang = r.lang and p.y = r.x
  left join inside i on p.lang = i.lang and p.x = i.x and p.y = i.y
  where i.f is null or 100 * i.f < 50 * p.f
),
c3 as (
  select t.lang, t.x || ' ' || t.y || ' ' || t.z as phrase, t.f as a, l1.f as l1, r1.f as r1, l2.f as l2, r2.f as r2,
         (1000000::hugeint * t.f * t.f) // (l1.f::hugeint * r1.f) as s1, (1000000::hugeint * t.f * t.f) // (l2.f::hugeint * r2.f) as s2
  from f3 t join f1 l1 on t.lang = l1.lang and t.x = l1.x join f2 r1 on t.lang = r1.lang and t.y = r1.x and t.z = r1.y
  join f2 l2 on t.lang = l2.lang and t.x = l2.x and t.y = l2.y join f1 r2 on t.lang = r2.lang and t.z = r2.x
),
c as (
  select lang, phrase, a, l, r, score from c2
  union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from c3
),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from c)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join sizes using (lang) where rank <= 2000
"""
