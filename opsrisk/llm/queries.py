"""Registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, jaccard, langid, mixing, ngram_lm, pages, periodic, quality, shared, suffix, topk, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def public_ranks() -> tuple[str, str]:
    """Place of the default rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_ranks()
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, pattern, keep_ids=False)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.interpolated_scores(table(spark, sf_dir, "documents")).drop("vocabulary")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.crc_fold(F.col("doc_id"), 4) == 2
    model = langid.learn(docs.where(~held_out).select(F.col("doc_id").alias("key"), "text", "lang"))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op8_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    held_out = langid.crc_fold(F.col("conv_id"), 4) == 2
    model = chat.learn(turns.where(~held_out))
    got = chat.recover_roles(turns.select("conv_id", "turn", "text"), model)
    return got.select("conv_id", "turn", "role_pred", "rendered", held_out.alias("held_out"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_copies(table(spark, sf_dir, "documents"))
    got = got.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def public_pair() -> tuple[str, str]:
    """Places of the default vocabularies that are aligned."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(table(spark, sf_dir, "documents"), *public_pair(), keep_groups=False)


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; where h = crc32(doc_id as text) is divisible by ten, the words from h // 10 mod n on repeat."""
    words, n = F.col("_w"), F.nullif(F.size("_w"), F.lit(0))
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    given = given.withColumn("_w", F.when(F.col("h") % 10 == 0, shared.words(F.col("text"))))
    g = F.floor(F.col("h") / 10)
    given = given.withColumn("_g", g).withColumn("_a", (g % n).cast("int"))
    rest = n - F.col("_a")
    period = (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int")
    given = given.withColumn("_p", period)
    unit = F.slice(words, F.col("_a") + 1, F.col("_p"))
    tail = F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("_p")).cast("int")))
    periodic_words = F.slice(F.concat(F.slice(words, F.lit(1), F.col("_a")), tail), F.lit(1), n)
    return given.select("doc_id", F.when(n > 0, F.array_join(periodic_words, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    best = F.col("best")
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = urls.page_labels(table(spark, sf_dir, "labels"))
    return urls.url_filter(table(spark, sf_dir, "pages"), labels).drop("purity")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_nra_top_k": op2_nra_top_k,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op7_language_id": op7_language_id,
    "op8_chat_roles": op8_chat_roles,
    "op9_main_text": op9_main_text,
    "op10_source_mix": op10_source_mix,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_filters": op13_url_filters,
}

ORACLE: dict[str, str] = {
    "op2_nra_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), placed as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from pairs
)
select query_id, rank, vec_id, score from placed where rank <= 10
""",
    "op13_url_filters": """
with page as (
  select page_id, url, strpos(url, '://') as mark from pages
), cut as (
  select page_id, case when mark > 0 then regexp_extract(substr(url, mark + 3), '^[^/?#]*') else '' end as raw, case when mark > 0 then substr(url, mark + 3) else '' end as rest
  from page
), base as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path,
    row_number() over () as id
  from cut
), seg as (
  select id, host, unnest(string_split(path, '/')) as segment, generate_subscripts(string_split(path, '/'), 1) as i from base
), reach as (
  select host, i, count(*) as total from seg group by all
), stay as (
  select host, i, segment from (select host, i, segment, count(*) as n from seg group by all) join reach using (host, i)
  where n >= 5 and segment <> '' and n >= total * 0.02::double
), general as (
  select id, i, case when s.segment = '' or t.host is not null then s.segment else '*' || regexp_extract(s.segment, '(\\.[A-Za-z]{1,5})$', 1) end as g
  from seg s left join stay t using (host, i, segment)
), templates as (
  select page_id, host, path, template from base join (select id, string_agg(g, '/' order by i) as template from general group by id) using (id)
), label as (
  select doc_id as page_id, max((quality = 0 or toxic = 1)::int) as bad from labels where doc_id is not null and (quality = 0 or toxic = 1) is not null group by 1
), counts as (
  select host, template, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from templates left join label using (page_id) group by all
), below as (
  select host, template, n, bad, unnest(generate_series(0, len(string_split(template, '/')))) as k from counts
), prefixes as (
  select *, array_to_string(string_split(template, '/')[1:k], '/') as node, array_to_string(string_split(template, '/')[1:k - 1], '/') as above from below
), nodes as (
  select host, k, node, min(case when k > 0 then above end) as above, sum(n)::double as n1, sum(bad)::double as b1 from prefixes group by host, k, node
), edges as (
  select c.host, c.k, c.node
  from nodes c join nodes p on p.host = c.host and p.k = c.k - 1 and p.node = c.above
  where c.n1 > 0 and p.n1 - c.n1 > 0
    and (c.b1 * (p.n1 - c.n1) - (p.b1 - c.b1) * c.n1) * (c.b1 * (p.n1 - c.n1) - (p.b1 - c.b1) * c.n1) * p.n1
      > 6.63::double * p.b1 * (p.n1 - p.b1) * c.n1 * (p.n1 - c.n1)
), placed as (
  select c.host, c.template, c.n, c.bad, coalesce(m.k, 0) as k, coalesce(m.node, '') as branch
  from counts c left join (
    select host, template, max(k) as k, arg_max(node, k) as node from prefixes join edges using (host, k, node) group by host, template
  ) m using (host, template)
), pooled as (
  select host, k, branch, sum(n)::bigint as n, sum(bad)::bigint as bad from placed group by all
), whole as (
  select case when sum(n) > 0 then (sum(n) - sum(bad))::double / sum(n)::double else 1.0::double end as overall from counts
), hosts as (
  select host, (sum(n - bad)::double + 10.0::double * overall) / (sum(n)::double + 10.0::double) as host_purity from pooled, whole group by host, overall
), judged as (
  select p.host, p.template, p.branch, q.n, q.bad, ((q.n - q.bad)::double + 10.0::double * host_purity) / (q.n::double + 10.0::double) as purity
  from placed p join pooled q using (host, k, branch) join hosts using (host)
), rules(verdict, rule, name, start) as (
  values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
    ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fits as (
  select t.host, t.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from (select distinct host, path from templates) t join rules r on (t.host = r.name or ends_with(t.host, '.' || r.name)) and starts_with(t.path, r.start)
  group by t.host, t.path
)
select t.page_id, t.host, t.path, f.rule, coalesce(f.verdict, case when purity < 0.5 then 'block' else 'allow' end) as verdict, t.template, j.branch, j.n as n_labelled, j.bad as n_bad
from templates t join judged j using (host, template) left join fits f on f.host = t.host and f.path = t.path
""",
}
