"""Registered queries: notes and their files, page orders, figures beside texts, whole-text twins of the searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render as R
from ..functions import text as T
from ..operators import classify, evaluate, fusion, ingest, lexical, maintain, vector
from .maintenance import _FOLDER_SQL, _FOLDERS
from .retrieval import _bm25_sql, _tok, head_key
from .tables import document_index, heads, table, texts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with f(folder, fo, kw, ko) as (values {_FOLDER_SQL}),
    p as (select p_partkey, p_brand || ' (' || p_type || ')' as title, case when p_size % 3 = 0 then [p_name] else [] end as tags, p_name || ' ' || p_type as body from part),
    t as (select p_partkey, unnest(list_concat(tags, [string_split(string_split(title, '(')[2], ')')[1]])) as tag, unnest(range(len(tags) + 1)) as tag_order from p),
    a as (select p_partkey, arg_min(folder, tag_order * 10000 + fo * 100 + ko) as folder from t join f on contains(lower(tag), kw) or contains(kw, lower(tag)) where trim(tag) <> '' group by p_partkey),
    b as (select p_partkey, arg_min(folder, fo * 100 + ko) as folder from p join f on contains(lower(substring(body, 1, 2000)), kw) group by p_partkey)
    select p.p_partkey, coalesce(a.folder, b.folder, case when starts_with(title, 'Brand#1') then 'ones' when starts_with(title, 'Brand#2') then 'twos' end, 'other') as folder,
      case when a.folder is not null then 'tags' when b.folder is not null then 'body' when starts_with(title, 'Brand#1') or starts_with(title, 'Brand#2') then 'title' else 'default' end as by
    from p left join a using (p_partkey) left join b using (p_partkey)""")
def filed_notes(spark, d):
    """Parts as notes: a third of them tagged, all with a bracketed word in the title."""
    folders = spark.createDataFrame(_FOLDERS, "folder string, folder_order int, keyword string, keyword_order int")
    p = table(spark, d, "part").select(
        "p_partkey", F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")).alias("title"), F.concat_ws(" ", "p_name", "p_type").alias("body"),
        F.when(F.col("p_size") % 3 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    return classify.filed(p, "p_partkey", "tags", "title", "body", folders, {"Brand#1": "ones", "Brand#2": "twos"}, "other")


@query("""with n as (select distinct string_split(p_name, ' ')[1] as name from part union select 'no such word' union select distinct source from documents)
    select name, exists (select 1 from documents where contains(text, name)) as found from n""")
def names_in_texts(spark, d):
    """Which words and sources occur in some text."""
    words = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("name")).union(table(spark, d, "documents").select("source")).union(spark.createDataFrame([("no such word",)], "name string"))
    return classify.holding(words, table(spark, d, "documents"), "name", "text")


@query(r"""with c as (select conv_id, turn, case when turn % 2 = 0 then '---' || chr(10) || 'role: ' || role || chr(10) || '---' || chr(10) || text else text end as content from conversations),
    s as (select *, instr(substring(content, 4), '---') as behind from c)
    select conv_id, turn, case when starts_with(content, '---') and behind > 0 then substring(content, 4, behind - 1) end as yaml,
      case when starts_with(content, '---') and behind > 0 then substring(content, behind + 6) else content end as body from s""")
def frontmatter_parts(spark, d):
    c = table(spark, d, "conversations")
    fm = F.concat(F.lit("---\nrole: "), "role", F.lit("\n---\n"), "text")
    p = T.frontmatter_parts(F.when(F.col("turn") % 2 == 0, fm).otherwise(F.col("text")))
    return c.select("conv_id", "turn", p["yaml"].alias("yaml"), p["body"].alias("body"))


@query("""select page_id, case when page_id % 2 = 0 then 'Page ' || page_id else 'Heading ' || page_id end as title, case when page_id % 2 = 0 then 'yes' else 'no' end as flag,
    case when page_id % 3 = 0 then '/a b/' || page_id || '+x.pdf' end as pdf, case when page_id % 5 = 0 then '2024-01-02' else '' end as ingested from pages""")
def note_fields(spark, d):
    """Notes made of pages' numbers, and their fields."""
    i, text = F.col("page_id").cast("string"), F.lit("")
    for c in (
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('---\ntitle: "Page '), i, F.lit('"\nflag: "yes"\n---\n'))).otherwise(F.concat(F.lit("---\nflag: no\n---\n# Heading "), i, F.lit("\n"))),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("[file](file:///a%20b/"), i, F.lit("+x.pdf)\n"))).otherwise(F.lit("[file](file:///a/b.txt)\n")),
        F.when(F.col("page_id") % 5 == 0, F.lit(f"{R.INGESTED}：`2024-01-02`")).otherwise(F.lit("")),
    ):
        text = F.concat(text, c)
    n = table(spark, d, "pages").select("page_id", text.alias("note"))
    return n.select("page_id", R.note_title(F.col("note")).alias("title"), R.note_field(F.col("note"), "flag").alias("flag"), R.linked_pdf(F.col("note")).alias("pdf"), R.note_date(F.col("note")).alias("ingested"))


_PATHS = r"""p as (select page_id, url as path, regexp_replace(url, '[^/]*$', '') as folder, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') as stem from pages where url is not null)"""


@query(rf"""with {_PATHS}, o as (select distinct folder, stem, regexp_replace(path, '(\.[^./]*)?$', '') || '.pdf' as companion from p where page_id % 2 = 1),
    a as (select stem, min(companion) as anywhere from o group by stem), b as (select folder, stem, min(companion) as beside from o group by folder, stem)
    select distinct path, coalesce(beside, anywhere) as companion from p join a using (stem) left join b using (folder, stem)""")
def nearest_companions(spark, d):
    """Of each address the file with its name, beside it or elsewhere; every second page has one."""
    p = table(spark, d, "pages").where("url is not null")
    name = F.regexp_replace("url", r"(\.[^./]*)?$", "")
    files = p.select(F.col("url").alias("path")).distinct()
    others = p.where("page_id % 2 = 1").select(F.concat(name, F.lit(".pdf")).alias("path")).distinct()
    return maintain.nearest_companions(files, others).select("path", "companion")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn % 3, turn) - 1 as place from conversations")
def descriptions_in_page_order(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("page"))
    return ingest.in_page_order(c, "conv_id", "page", "turn").select("conv_id", "turn", "place")


@query("select conv_id, role, string_agg(text, chr(10) order by turn) as text, round(avg(1.0::double / (1 + turn)), 6) as confidence, count(*) as n_lines from conversations group by conv_id, role")
def recognised_lines(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", "turn", "text", (F.lit(1.0) / (1 + F.col("turn"))).alias("confidence"))
    return ingest.recognised(c, ["conv_id", "role"], "turn").withColumn("confidence", F.round("confidence", 6))


@query("""select source, chunk_type, count(*) as n, sum(chars)::bigint as chars from (
    select '/c/' || conv_id || '.pdf' as source, 'figure' as chunk_type, length(text) as chars from conversations where turn % 4 = 0 and text <> ''
    union all select '/c/' || conv_id || '.pdf', 'text', length(regexp_replace(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) from conversations where trim(text, ' ' || chr(10) || chr(9)) <> '')
    group by source, chunk_type""".replace("\\\\", "\\"))
def texts_and_figures(spark, d):
    """Conversations as files of a page a turn, every fourth with a figure: rows of one chunk table, counted by kind."""
    c = table(spark, d, "conversations").withColumn("source", F.concat(F.lit("/c/"), F.col("conv_id").cast("string"), F.lit(".pdf")))
    pages = c.select("source", F.col("turn").alias("page"), "text")
    figures = c.where("turn % 4 = 0").select("source", F.col("turn").alias("page"), F.col("text").alias("description"), F.lit("figure").alias("kind"), F.lit("").alias("figure_path"))
    rows = ingest.document_rows(pages, figures, most=100_000, overlap=0)
    return rows.groupBy("source", "chunk_type").agg(F.count("*").alias("n"), F.sum(F.col("char_count").cast("long")).alias("chars"))


# --- Whole texts, all languages, all documents


@query(f"""with d as (select doc_id, lang, unnest({_tok('text')}) as term from documents), n as (select lang, count(*) as n from documents group by lang),
    f as (select lang, term, count(distinct doc_id) as df from d group by lang, term)
    select f.lang, term, df, round(ln(1.0::double + (n - df + 0.5) / (df + 0.5)), 6) as idf from f join n on n.lang is not distinct from f.lang""")
def idf_of_languages(spark, d):
    """Inverse document frequency of each term in each language's documents."""
    return lexical.idf_by(texts(spark, d, "doc_id", "text", "lang"), "doc_id", "lang").select("lang", "term", "df", F.round("idf", 6).alias("idf"))


@query(f"""with w as (select doc_id, ('0x' || substr(md5(word), 1, 8))::bigint as h from (select doc_id, unnest({_tok('text')}) as word from documents)),
    s as (select doc_id, h % 64 as slot, sum(case when (h // 64) % 2 = 0 then 1.0::double else -1.0::double end) as v from w group by doc_id, h % 64)
    select doc_id, slot, round((v / sqrt(sum(v * v) over (partition by doc_id)))::float::double, 5) as x from s where v <> 0""")
def document_embeddings(spark, d):
    """Hashed embeddings of whole documents: the coordinates that aren't zero."""
    v = texts(spark, d).select("doc_id", vector.hashed_embedding(F.col("text")).alias("vector"))
    return v.select("doc_id", F.posexplode("vector").alias("slot", "x")).where("x <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("x").cast("double"), 5).alias("x"))


_EVERY = "select doc_id as query_id, text as query from documents"
_WHOLE = f"{_EVERY} where doc_id % 20 = 0"


def _every(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _whole(spark, d):
    return _every(spark, d).where("query_id % 20 = 0")


@query(f"with {_bm25_sql(_EVERY)} select query_id, doc_id, score, rank from bm")
def similar_texts(spark, d):
    """Full-text search with every document, whole, as a query."""
    return document_index(spark, d).search(_every(spark, d))


@query(f"""with {_bm25_sql(_WHOLE)}, j as (select bq.query_id, min(case when bm.doc_id = bq.query_id then rank end) as hit_rank from bq left join bm using (query_id) group by bq.query_id)
    select count(*) as n_queries, count(hit_rank) as n_hits, round(avg((hit_rank is not null)::int::double), 6) as hit_rate, round(avg(coalesce(1.0::double / hit_rank, 0)), 6) as mrr from j""")
def eval_whole_texts(spark, d):
    """Self-retrieval of whole documents."""
    q = _whole(spark, d)
    golden = q.select("query_id", F.col("query_id").cast("string").alias("expected_id"), F.lit("none").alias("expected_source"))
    got = document_index(spark, d).search(q, expected=q.select("query_id", F.col("query_id").alias("doc_id")))
    got = got.select("query_id", "rank", F.col("doc_id").cast("string").alias("id"), F.lit("").alias("source"))
    return evaluate.summary(evaluate.judged(golden, got)).select("n_queries", "n_hits", "hit_rate", "mrr")


_FUSED_WHOLE = f"""with {_bm25_sql(_WHOLE)},
    v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    kx as (select a.vec_id as query_id, b.vec_id as doc_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) as distance from v a, v b where a.vec_id % 20 = 0 and a.vec_id in (select doc_id from documents)),
    kn as (select * from (select *, row_number() over (partition by query_id order by distance, doc_id) as rank from kx) where rank <= 15),
    h as (select query_id, doc_id, rank, 0 as part from kn where doc_id in (select doc_id from documents) union all select query_id, doc_id, rank, 1 from bm),
    k as (select h.*, md5(substring(d.text, 1, 200)) as key from h join documents d using (doc_id)),
    r as (select *, row_number() over (partition by query_id, part order by rank) as place from k),
    f as (select query_id, key, round(sum(1.0::double / (60 + place)), 12) as rrf from r group by query_id, key)
    select query_id, key, rrf from f"""


@query(_FUSED_WHOLE)
def hybrid_whole_texts(spark, d):
    """Nearest vectors and full-text hits of whole documents, fused by reciprocal rank."""
    vectors = table(spark, d, "embeddings")
    q = _whole(spark, d)
    near = vector.knn(vectors, vectors.join(q.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "vec_id", "embedding")
    near = near.select("query_id", F.col("vec_id").alias("doc_id"), (-F.col("rank")).cast("double").alias("score"), "rank", F.lit("vector").alias("track"))
    text = document_index(spark, d).search(q).select("query_id", "doc_id", (-F.col("rank")).cast("double").alias("score"), "rank", F.lit("fts").alias("track"))
    hits = fusion.tracks(near, text).join(heads(spark, d), "doc_id").withColumn("id", F.col("doc_id").cast("string"))
    return fusion.rrf(hits, key=head_key()).select("query_id", "key", "rrf")
