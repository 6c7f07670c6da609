"""The corpus operators over the given tables, each registered with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.llm import alignment, benchmark_leaks, hard_negatives, languages, near_duplicates, packed_ids, piece_tokens, quality, repeated_text, secret_spans, token_counts, top_products, urls
from tablekit.plans.registry import Tables, query


@query("op1_near_duplicates")
def op1_near_duplicates(t: Tables) -> DataFrame:
    return near_duplicates.near_duplicates(t("documents"))


@query("op2_piece_tokens")
def op2_piece_tokens(t: Tables) -> DataFrame:
    return piece_tokens.encode_decode(t("documents"))


@query("op3_quality")
def op3_quality(t: Tables) -> DataFrame:
    documents = t("documents")
    return quality.score_quality(documents, quality.fit_quality(documents, t("labels")))


@query("op4_languages")
def op4_languages(t: Tables) -> DataFrame:
    documents = t("documents")
    found = languages.identify(documents, languages.fit_languages(documents))
    # The mixture as text, so that rows compare plainly.
    mixture = F.concat_ws(",", F.transform("languages", lambda x: F.concat_ws(":", x["lang"], F.format_number(x["share"], 3))))
    return found.withColumn("languages", mixture)


@query("op5_repeated_text")
def op5_repeated_text(t: Tables) -> DataFrame:
    return repeated_text.repeated_bytes(t("documents"))


@query("op6_packed_ids")
def op6_packed_ids(t: Tables) -> DataFrame:
    return packed_ids.packed_round_trip(t("documents"))


@query(
    "op7_top_products",
    """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings),
    s as (
      select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
    ),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id, score from r where rank <= 20
    """,
)
def op7_top_products(t: Tables) -> DataFrame:
    vectors = top_products.integer_vectors(t("embeddings"))
    return top_products.top_products(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query("op8_benchmark_leaks")
def op8_benchmark_leaks(t: Tables) -> DataFrame:
    return benchmark_leaks.leaks(t("documents"), t("benchmark"))


#: Captures and a dated list, derived from pages by the same rules in both engines: every host and every host with a
#: first path segment is listed, delisted and listed again on days that follow from its length and its page count;
#: the two top domains of hosts are listed once.
_CAPTURES = "page_id, url, 1704067200 + (page_id * 1234577) % 31536000 as t"
_ADDRESS = r"regexp_extract(url, '//([^/?#]+)', 1)"
_SEGMENT = r"regexp_extract(url, '//([^/?#]+/[^/?#]+)', 1)"
_ENTRIES = f"""
  select 'hosts' as list, {_ADDRESS} as pattern, count(*) as n from pages group by 2
  union all select 'paths', {_SEGMENT}, count(*) from pages group by 2
"""
_LOG = """
  select list, pattern, 'first' as category, 1704067200 + 86400 * ((length(pattern) * 37 + n) % 200) as since, true as active from e
  union all select list, pattern, '', 1704067200 + 86400 * ((length(pattern) * 37 + n) % 200 + 20 + length(pattern) % 60), false from e
  union all select list, pattern, 'again', 1704067200 + 86400 * ((length(pattern) * 37 + n) % 200 + 60 + length(pattern) % 60), true from e
  union all select 'domains', 'example.org', 'domain', 1704067200 + 86400 * 300, true from e
"""


@query(
    "op9_url_filter",
    f"""
    with c as (select {_CAPTURES} from pages), e as ({_ENTRIES}), log as (select distinct * from ({_LOG}) where pattern <> ''),
    spans as (
      select *, coalesce(lead(since) over (partition by list, pattern order by since), 253402300799) as until from log
    ),
    a as (
      select *, lower({_ADDRESS}) as host, regexp_replace(lower({_ADDRESS}) || regexp_extract(url, '//[^/?#]+(/[^?#]*)', 1), '/+$', '') as address from c
    ),
    m as (
      select page_id, list, pattern, category, since,
        row_number() over (partition by page_id order by length(pattern) desc, since desc, list, pattern, category) as k,
        count(*) over (partition by page_id) as n
      from a join spans on since <= t and t < until and active
        and (host = pattern or ends_with(host, '.' || pattern) or address = pattern or starts_with(address, pattern || '/'))
    )
    select c.page_id, c.t as fetched, m.k is not null as blocked, coalesce(m.n, 0) as n_matches, m.list, m.pattern, m.category, m.since
    from c left join m on c.page_id = m.page_id and m.k = 1
    """,
)
def op9_url_filter(t: Tables) -> DataFrame:
    pages = t("pages").select("page_id", "url")
    captures = pages.selectExpr(*_CAPTURES.split(", ")).withColumn("fetched_at", F.timestamp_seconds("t"))
    spark = pages.sparkSession
    counts = spark.sql(_ENTRIES.replace("from pages", "from {pages}"), pages=pages)
    log = spark.sql(_LOG.replace("from e", "from {e}"), e=counts).withColumn("listed_at", F.timestamp_seconds("since"))
    found = urls.filter_urls(captures, log)
    return found.select(F.col("id").alias("page_id"), F.unix_seconds("fetched_at").alias("fetched"), "blocked", "n_matches", "list", "pattern", "category", "since")


@query("op10_token_counts")
def op10_token_counts(t: Tables) -> DataFrame:
    return token_counts.count_tokens(t("documents"))


@query(
    "op11_hard_negatives",
    """
    with e as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings
      where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: x is not null and isfinite(x)), false)
    ),
    s as (
      select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
      from e a join e c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
    ),
    p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
    n as (
      select p.*, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
    )
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
    """,
)
def op11_hard_negatives(t: Tables) -> DataFrame:
    vectors = hard_negatives.labelled_vectors(t("embeddings"))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


@query("op12_cross_alignment")
def op12_cross_alignment(t: Tables) -> DataFrame:
    return alignment.cross_alignment(t("documents"))


@query("op13_secret_spans")
def op13_secret_spans(t: Tables) -> DataFrame:
    documents = t("documents")
    return secret_spans.find_secrets(documents, secret_spans.fit_secrets(documents))
