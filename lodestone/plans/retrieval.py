"""Registered queries: full text, vectors, fusion, reranking, context, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, evaluate, fusion, lexical, rerank, vector
from .tables import document_index, heads, hybrid_queries, item_queries, table, texts, vector_queries


def head_key():
    """How the queries' SQL tells contents apart."""
    return T.head_key(F.col("raw_text"))


def _docs(spark, d):
    return table(spark, d, "documents")


def tokenize_stats(spark, d):
    w = T.tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def term_frequencies(spark, d):
    p = lexical.postings(texts(spark, d), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark, d):
    s = lexical.corpus_stats(texts(spark, d))
    return s.select("n_docs", "total_len", F.round("avg_len", 6).alias("avg_len"))


def idf_by_language(spark, d):
    """Inverse document frequency of the terms of English documents."""
    t = lexical.idf_table(texts(spark, d, "doc_id", "text", "lang").where("lang = 'en'"), "doc_id")
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return document_index(spark, d).search(item_queries(spark, d))


def bm25_filtered(spark, d):
    return lexical.bm25(texts(spark, d, "doc_id", "text", "lang"), item_queries(spark, d), "doc_id", where="lang = 'en'")


def fts_normalised(spark, d):
    return bm25_topk(spark, d).select("query_id", "doc_id", F.round(lexical.normalised(F.col("score")), 6).alias("norm_score"))


def _knn(spark, d, **kw):
    return vector.knn(table(spark, d, "embeddings"), vector_queries(spark, d), "vec_id", "embedding", **kw)


def knn_l2(spark, d):
    return _knn(spark, d)


def knn_cosine(spark, d):
    return _knn(spark, d, metric="cosine", k=10).select("query_id", "vec_id", "distance", "rank")


def knn_filtered(spark, d):
    return _knn(spark, d, where="label < 5", k=10)


def _hits(spark, d):
    """Vector hits, then full-text hits, of each hybrid query. As raw_text they have the part that tells contents apart; ``_with_texts`` gives the whole."""
    q = hybrid_queries(spark, d)
    near = vector.knn(table(spark, d, "embeddings"), q, "vec_id", "embedding").select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank", F.lit("vector").alias("track"))
    text = document_index(spark, d).search(q.select("query_id", "query")).select("query_id", "doc_id", lexical.normalised(F.col("score")).alias("score"), "rank", F.lit("fts").alias("track"))
    hits = fusion.tracks(near, text)
    return hits.join(heads(spark, d), "doc_id").withColumn("id", F.col("doc_id").cast("string")), q


def _with_texts(spark, d, rows):
    """Fused rows with the whole text of the document that represents each."""
    body = _docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_text"))
    return rows.drop("raw_text").join(body, "id")


def rrf_two_track(spark, d):
    hits, _ = _hits(spark, d)
    return fusion.rrf(hits, key=head_key()).select("query_id", "id", "key", "rrf", "track", "rank")


def hybrid_search(spark, d):
    return rrf_two_track(spark, d).where("rank <= 5").select("query_id", "id", "rrf", "track", "rank")


def keep_best(spark, d):
    hits, _ = _hits(spark, d)
    return fusion.keep_best(hits, head_key()).select("query_id", "key", "id", "track", F.round("score", 6).alias("score"))


def rerank_min_keep(spark, d):
    hits, q = _hits(spark, d)
    fused = _with_texts(spark, d, fusion.rrf(hits, key=head_key()).select("query_id", "id", F.col("rrf").alias("score"), F.col("rank").alias("seq")))
    ranked = rerank.rerank(fused.join(q.select("query_id", "query"), "query_id"), rerank.overlap_score(F.col("query"), F.col("raw_text")))
    return ranked.select("query_id", "id", F.round("original_score", 9).alias("original_score"), "rerank_score", "rank")


def _top(spark, d):
    hits, q = _hits(spark, d)
    top = _with_texts(spark, d, fusion.rrf(hits, key=head_key()).where("rank <= 5"))
    return top.withColumn("chunk_type", F.lit("text")).withColumn("page", F.lit(0)), q


def context_budget(spark, d):
    top, _ = _top(spark, d)
    return context.build(top, 1500)


def context_prompt(spark, d):
    top, q = _top(spark, d)
    p = context.render(q.select("query_id", "query"), context.build(top, 600), "summary")
    return p.select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


def eval_metrics(spark, d):
    """Self-retrieval: does the full-text search of a document's first 60 characters find it among ten?"""
    q = _docs(spark, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    golden = q.select("query_id", F.col("query_id").cast("string").alias("expected_id"), F.lit("none").alias("expected_source"))
    got = document_index(spark, d).search(q, expected=q.select("query_id", F.col("query_id").alias("doc_id")))
    got = got.select("query_id", "rank", F.col("doc_id").cast("string").alias("id"), F.lit("").alias("source"))
    s = evaluate.summary(evaluate.judged(golden, got))
    return s.withColumns({"hit_band": evaluate.band(F.col("hit_rate"), 0.8, 0.6), "mrr_band": evaluate.band(F.col("mrr"), 0.6, 0.4)})


def latency_stats(spark, d):
    e = table(spark, d, "events").withColumn("ms", F.col("value") * 10)
    s = evaluate.latency(e, "ms", F.col("event_type") != "error")
    return s.withColumn("band", evaluate.latency_band(F.col("avg_ms")))


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("n_tokens"))


def default_embedding(spark, d):
    """Hashed embeddings of the benchmark items: the coordinates that aren't zero."""
    v = vector.hashed_embeddings(table(spark, d, "benchmark"), "item_id", "text")
    return v.select("item_id", F.posexplode("vector").alias("slot", "x")).where("x <> 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("x").cast("double"), 5).alias("x"))


_TOK = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _tok(c: str) -> str:
    return _TOK.format(c)


def _bm25_sql(queries: str, corpus: str = "documents", k: int = 10) -> str:
    return f"""
bq as ({queries}),
bd as (select doc_id, {_tok('text')} as words from {corpus}),
bs as (select count(*) as n_docs, avg(len(words)) as avg_len from bd),
bt as (select doc_id, term, count(*) as tf, any_value(doc_len) as doc_len
       from (select doc_id, unnest(words) as term, len(words) as doc_len from bd) group by doc_id, term),
bw as (select distinct query_id, term from (select query_id, unnest({_tok('query')}) as term from bq)),
bf as (select term, count(*) as df from bt group by term),
bx as (select bw.query_id, bt.doc_id,
         round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * doc_len / avg_len))), 6) as score
       from bw join bt using (term) join bf using (term), bs group by bw.query_id, bt.doc_id),
bm as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from bx) where rank <= {k})"""


def _knn_sql(queries: str, k: int, where: str = "true", metric: str = "l2") -> str:
    v = "list_transform(embedding, lambda x: x::double)"
    f = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" if metric == "l2" else "1 - list_cosine_similarity(a, b)"
    return f"""
kq as ({queries}),
kx as (select query_id, vec_id, round({f}, 6) as distance
       from (select query_id, list_transform(query_vector, lambda x: x::double) as a from kq),
            (select vec_id, {v} as b from embeddings where {where})),
kn as (select *, round(1.0::double / (1.0::double + distance), 6) as score from
        (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from kx) where rank <= {k})"""


_ITEMS = "select item_id as query_id, text as query from benchmark where item_id % 20 = 0"
_VECTORS = "select vec_id as query_id, embedding as query_vector from embeddings where vec_id % 20 = 0"
_HYBRID = "select d.doc_id as query_id, substring(d.text, 1, 60) as query, e.embedding as query_vector from documents d join embeddings e on e.vec_id = d.doc_id where d.doc_id % 20 = 0"

_FUSED = f"""
hq as ({_HYBRID}),
{_knn_sql('select query_id, query_vector from hq', 15)},
{_bm25_sql('select query_id, query from hq')},
h0 as (select query_id, vec_id as doc_id, score, rank, 'vector' as track, 0 as part from kn union all
       select query_id, doc_id, case when score > 0 then least(1.0::double, score / 10) else 0.1 end, rank, 'fts', 1 from bm),
h1 as (select *, row_number() over (partition by query_id order by part, rank) as seq from h0),
h2 as (select h1.*, d.text as raw_text, d.source, md5(substring(d.text, 1, 200)) as key from h1 join documents d using (doc_id)),
h3 as (select *, row_number() over (partition by query_id, track order by score desc, seq) as track_rank, min(seq) over (partition by query_id, track) as track_order from h2),
h4 as (select query_id, key, round(sum(1.0::double / (60 + track_rank)), 12) as rrf, arg_min(doc_id, track_order * 100000 + track_rank) as doc_id,
         arg_min(track, track_order * 100000 + track_rank) as track, arg_min(raw_text, track_order * 100000 + track_rank) as raw_text,
         arg_min(source, track_order * 100000 + track_rank) as source, min(track_order * 100000 + track_rank) as met from h3 group by query_id, key),
fused as (select *, cast(doc_id as varchar) as id, row_number() over (partition by query_id order by rrf desc, met) as rank from h4)"""


def _context_sql(tokens: int) -> str:
    budget = int(tokens * 1.5)
    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return f"""
c1 as (select query_id, rank, '[' || rank || '] ' || source || chr(10) || raw_text as part from fused where rank <= 5),
c2 as (select *, sum(length(part) + 7) over (partition by query_id order by rank) as total, sum(length(part) + 7) over (partition by query_id) - 7 as everything from c1),
c3 as (select *, everything <= {budget} or total <= {budget} as fits from c2),
c4 as (select query_id, string_agg(part, {sep} order by rank) filter (where fits) as whole, count(*) filter (where fits) as n_used, count(*) as n_all, arg_min(part, rank) as first from c3 group by query_id),
ctx as (select query_id, case when n_used > 0 then whole || case when n_used < n_all then chr(10) || chr(10) || '(' || n_used || ' of ' || n_all || ' passages)' else '' end
          else substring(first, 1, {budget} - 6) || chr(10) || '[cut]' end as context, n_used, n_all from c4)"""


_SUMMARY = context.TEMPLATES["summary"].replace("{extra}", "").replace("'", "''").replace("\n", "' || chr(10) || '")

ORACLES = {
    "tokenize_stats": f"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct from (select doc_id, {_tok('text')} as w from documents)",
    "term_frequencies": f"select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_tok('text')}) as term from documents) group by term",
    "corpus_stats": f"select count(*) as n_docs, cast(sum(len(w)) as bigint) as total_len, round(avg(len(w)), 6) as avg_len from (select {_tok('text')} as w from documents)",
    "idf_by_language": f"""with n as (select count(*) as n from documents where lang = 'en'),
        d as (select term, count(distinct doc_id) as df from (select doc_id, unnest({_tok('text')}) as term from documents where lang = 'en') group by term)
        select term, df, round(ln(1.0::double + (n - df + 0.5) / (df + 0.5)), 6) as idf from d, n""",
    "bm25_topk": f"with {_bm25_sql(_ITEMS)} select query_id, doc_id, score, rank from bm",
    "bm25_filtered": f"with {_bm25_sql(_ITEMS, '(select * from documents where lang = ' + chr(39) + 'en' + chr(39) + ')')} select query_id, doc_id, score, rank from bm",
    "fts_normalised": f"with {_bm25_sql(_ITEMS)} select query_id, doc_id, round(case when score > 0 then least(1.0::double, score / 10) else 0.1 end, 6) as norm_score from bm",
    "knn_l2": f"with {_knn_sql(_VECTORS, 15)} select query_id, vec_id, distance, score, rank from kn",
    "knn_cosine": f"with {_knn_sql(_VECTORS, 10, metric='cosine')} select query_id, vec_id, distance, rank from kn",
    "knn_filtered": f"with {_knn_sql(_VECTORS, 10, 'label < 5')} select query_id, vec_id, distance, score, rank from kn",
    "rrf_two_track": f"with {_FUSED} select query_id, id, key, rrf, track, rank from fused",
    "hybrid_search": f"with {_FUSED} select query_id, id, rrf, track, rank from fused where rank <= 5",
    "keep_best": f"""with {_FUSED}, b as (select *, row_number() over (partition by query_id, key order by score desc, seq) as n from h2)
        select query_id, key, cast(doc_id as varchar) as id, track, round(score, 6) as score from b where n = 1""",
    "rerank_min_keep": f"""with {_FUSED},
        r1 as (select f.query_id, id, rrf, rank as seq, list_distinct({_tok('query')}) as q, list_distinct({_tok('raw_text')}) as t from fused f join hq using (query_id) where raw_text <> ''),
        r2 as (select *, round(1.0::double / (1.0::double + exp(-(6.0::double * len(list_intersect(q, t)) / greatest(len(q), 1) - 3.0::double))), 6) as rerank_score from r1),
        r3 as (select *, count(*) filter (where rerank_score >= 0.4) over (partition by query_id) as n_ok, row_number() over (partition by query_id order by rerank_score desc, seq) as rank from r2)
        select query_id, id, round(rrf, 9) as original_score, rerank_score, rank from r3 where rank <= 5 and case when n_ok < 3 then rank <= 3 else rerank_score >= 0.4 end""",
    "context_budget": f"with {_FUSED}, {_context_sql(1500)} select query_id, context, n_used, n_all from ctx",
    "context_prompt": f"""with {_FUSED}, {_context_sql(600)}, p as (select hq.query_id, replace(replace('{_SUMMARY}', '{{context}}', coalesce(context, '{context.EMPTY}')), '{{query}}', query) as prompt
        from hq left join ctx using (query_id)) select query_id, md5(prompt) as prompt_md5, length(prompt) as n_chars from p""",
    "eval_metrics": f"""with {_bm25_sql('select doc_id as query_id, substring(text, 1, 60) as query from documents where doc_id % 20 = 0')},
        j as (select bq.query_id, min(case when bm.doc_id = bq.query_id then rank end) as hit_rank from bq left join bm using (query_id) group by bq.query_id),
        s as (select count(*) as n_queries, count(hit_rank) as n_hits, round(avg((hit_rank is not null)::int::double), 6) as hit_rate, round(avg(coalesce(1.0::double / hit_rank, 0)), 6) as mrr from j)
        select *, case when hit_rate > 0.8 then 'good' when hit_rate > 0.6 then 'fair' else 'poor' end as hit_band, case when mrr > 0.6 then 'good' when mrr > 0.4 then 'fair' else 'poor' end as mrr_band from s""",
    "latency_stats": """with s as (select count(*) as n, round(count(*) filter (where event_type <> 'error')::double / count(*), 6) as success_rate, round(min(value * 10), 6) as min_ms, round(max(value * 10), 6) as max_ms, round(avg(value * 10), 6) as avg_ms from events)
        select *, case when avg_ms < 500 then 'good' when avg_ms < 1000 then 'fair' else 'poor' end as band from s""",
    "token_estimate": "select doc_id, cast(floor(length(text) / 1.5::double) as integer) as n_tokens from documents",
}

ORACLES["default_embedding"] = f"""with w as (select item_id, ('0x' || substr(md5(word), 1, 8))::bigint as h from (select item_id, unnest({_tok('text')}) as word from benchmark)),
    s as (select item_id, h % 64 as slot, sum(case when (h // 64) % 2 = 0 then 1.0::double else -1.0::double end) as v from w group by item_id, h % 64)
    select item_id, slot, round((v / sqrt(sum(v * v) over (partition by item_id)))::float::double, 5) as x from s where v <> 0"""

QUERIES = {n: globals()[n] for n in ORACLES}
