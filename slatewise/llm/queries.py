"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm import fingerprints, language, mixing, negatives, ngram_join, packing, prefix_trie, resample, retrieval_packing, secrets, topk, urls, warc
from slatewise.llm.common import table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), urls.bad_page().alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labels)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, vectors.where("id % 100 = 0"), k=10)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return negatives.mine(rows, rows.where("id % 100 = 0"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_importance_resampling, op2_secret_scan, op3_warc_transactions, op4_host_reputation, op5_best_fit_packing,
        op6_canonical_digest, op7_exact_topk, op8_mixing, op9_language_id, op10_ngram_jaccard,
        op11_retrieval_packing, op12_hard_negatives, op13_prefix_trie,
    )
}

#: crc32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)), lambda r, b: list_reduce(list_prepend(xor(r, b), list_transform(range(8), lambda k: 0::bigint)), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"

SQL: dict[str, str] = {
    "op12_hard_negatives": """
        with v as (select vec_id id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) t from embeddings
          where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as materialized (select a.id anchor_id, a.label own, c.id, c.label, list_dot_product(a.t, c.t)::bigint score from v a join v c on a.id % 100 = 0 and c.id <> a.id),
        p as (select anchor_id, id positive_id, score positive_score, row_number() over (partition by anchor_id order by score desc, id) n from s where label = own),
        r as (select p.anchor_id, positive_id, id negative_id, positive_score, score negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) rank
          from p join s on s.anchor_id = p.anchor_id and label <> own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score where n <= 5)
        select anchor_id, positive_id, rank::integer rank, negative_id, positive_score, negative_score from r where rank <= 10""",
    "op13_prefix_trie": f"""
        with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) n, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') u, length(coalesce(text, '')) k from conversations where conv_id is not null),
        o as (select c, {_CRC} % 6 h from (select distinct c from t)),
        w as (select o.c, n, u, k from o join t on t.c = o.c - o.c % 100 and n <= h union all select o.c, n, u, k from o join t on t.c = o.c and n > h),
        m as (select c, row_number() over (partition by c order by n) d, u, k from w),
        p as (select o.c, 0 d, 0 k, '' node, null up from o union all select c, d, k, array_to_string(list(sha256(u)) over (partition by c order by d), ''), null from m),
        x as materialized (select c, d, k, sha256(node) node, lag(sha256(node)) over (partition by c order by d) up, d = max(d) over (partition by c) as ends from p),
        g as materialized (select node, any_value(up) up, any_value(d) d, any_value(k) k, min(c) c, count(*) n, coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '') e from x group by node),
        kids as (select up, count(*) n from g group by up),
        a as materialized (select y.node, g.node under, (g.n - 1) * g.k saved, kids.n is null leaf from g join x on x.c = g.c and x.node = g.node join x y on y.c = x.c and y.d <= x.d left join kids on kids.up = g.node),
        s as (select node, sum(saved)::bigint saved, count(case when leaf then 1 end) leaves from a group by node)
        select g.c conv_id, g.d::bigint depth, up.c parent_conv_id, g.n n_convs, coalesce(kids.n, 0) n_children, leaves n_leaves, saved saved_tokens, sha256(g.e) ends_sha256
        from g left join g up on up.node = g.up left join kids on kids.up = g.node join s on s.node = g.node""",
    "op3_warc_transactions": """
        with p as (select page_id, sha256(coalesce(html, '')) d, octet_length(encode(coalesce(html, '')))::bigint n from pages),
        f as (select d, min(page_id) f from p where n >= 100 group by d having count(*) > 1)
        select page_id, n payload_bytes, p.d payload_digest, case when f is not null and page_id is distinct from f then 'revisit' else 'response' end record_type,
          case when f is not null and page_id is distinct from f then f end refers_to
        from p left join f on f.d = p.d""",
    "op4_host_reputation": urls.judge_sql(),
    "op7_exact_topk": """
        with v as (select vec_id id, list_transform(embedding, lambda x: floor(1024 * x::double)) t from embeddings
          where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.id query_id, c.id vec_id, list_dot_product(q.t, c.t)::bigint score from v q join v c on q.id % 100 = 0 and c.id <> q.id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
        select query_id, rank::integer rank, vec_id, score from r where rank <= 10""",
    "op8_mixing": "with " + ", ".join(mixing.mix_sql()[0]) + " " + mixing.mix_sql()[1],
    "op10_ngram_jaccard": f"""
        with recursive w as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\\x20\\x09-\\x0D]+') w from documents),
        g as (select r, doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from w),
        n as (select r, doc_id, len(s) n from g),
        x as (select r, unnest(s) s from g),
        o as (select a.r a, b.r b, count(*) k from x a join x b on a.s = b.s and a.r < b.r group by all),
        l as materialized (select a, b from o join n na on na.r = a join n nb on nb.r = b where 100 * k >= 75 * (na.n + nb.n - k)),
        both_ways as materialized (select a, b from l union select b, a from l),
        c as (select r, r c from n union select e.b, c.c from c join both_ways e on e.a = c.r),
        m as (select c.r, min(d.doc_id) component_id from c join n d on d.r = c.c group by c.r)
        select doc_id, n n_shingles, component_id from n join m using (r)""",
}
