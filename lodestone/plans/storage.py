"""Registered queries over stored tables and indexes: versions, time travel, upkeep of the full-text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fulltext import TextIndex
from ..sources.shared import new_folder
from ..sources.versions import VersionedTable
from .retrieval import _ITEMS, _bm25_sql
from .tables import item_queries, table

FIELDS = ("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def _orders_table(spark, d) -> VersionedTable:
    """Orders by customer: closed ones appended, then the others; customers with a pending order have theirs replaced by that one at a
    price of zero; customers of the BUILDING segment are deleted."""
    orders = table(spark, d, "orders").select(*FIELDS)
    t = VersionedTable(spark, new_folder(spark, "orders"), "o_custkey", 16)
    t.append(orders.where("o_orderstatus = 'F'"))
    t.append(orders.where("o_orderstatus <> 'F'"))
    t.upsert(orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)))
    t.delete(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")))
    return t


def _summed(rows, n):
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(n).cast("long").alias("version"), "o_orderstatus", "n_rows", "total")


def table_versions(spark, d):
    """What each version holds, read when all have been written."""
    t = _orders_table(spark, d)
    out = None
    for n in range(4):
        part = _summed(t.read(n), n)
        out = part if out is None else out.unionByName(part)
    return out


def table_vacuumed(spark, d):
    """The last version after everything else has been deleted, and after a clear and another append."""
    t = _orders_table(spark, d)
    t.vacuum(keep=1, older_ms=-1)
    first = t.version().number
    before = t.read(first)
    t.clear()
    t.append(before.where("o_orderstatus = 'O'"))
    return _summed(t.read(first), 3).unionByName(_summed(t.read(), 5))


def index_upkeep(spark, d):
    """Search of an index that was filled by language, with one source's documents deleted and another's replaced."""
    docs = table(spark, d, "documents")
    index = TextIndex(spark, new_folder(spark, "text-index"), "doc_id")
    for lang in ("en", "de", "fr"):
        index.add(docs.where(F.col("lang") == lang))
    index.add(docs.where("lang is null or lang not in ('en', 'de', 'fr')"))
    index.delete(docs.where("source = 'src1'"))
    index.upsert(docs.where("source = 'src2'").withColumn("text", F.concat_ws(" ", F.col("text"), F.col("source"))))
    return index.search(item_queries(spark, d))


def index_statistics(spark, d):
    """Document frequencies of an index after a deletion."""
    docs = table(spark, d, "documents")
    index = TextIndex(spark, new_folder(spark, "text-index"), "doc_id")
    index.add(docs)
    index.delete(docs.where("source = 'src1'"))
    return index.frequencies().select("term", "df")


_VERSIONS = """with o as (select o_custkey, o_orderkey, o_orderstatus, o_totalprice from orders),
    p as (select distinct o_custkey from o where o_orderstatus = 'P'),
    v2 as (select * from o where o_custkey not in (select o_custkey from p) union all select o_custkey, o_orderkey, o_orderstatus, 0.0 from o where o_orderstatus = 'P'),
    v3 as (select * from v2 where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')),
    v as (select 0 as version, * from o where o_orderstatus = 'F' union all select 1, * from o union all select 2, * from v2 union all select 3, * from v3
          union all select 5, * from v3 where o_orderstatus = 'O')
    select version, o_orderstatus, count(*) as n_rows, round(sum(o_totalprice), 2) as total from v where version in ({}) group by version, o_orderstatus"""

_CORPUS = "(select doc_id, case when source = 'src2' then concat_ws(' ', text, source) else text end as text from documents where source is distinct from 'src1')"

ORACLES = {
    "table_versions": _VERSIONS.format("0, 1, 2, 3"),
    "table_vacuumed": _VERSIONS.format("3, 5"),
    "index_upkeep": f"with {_bm25_sql(_ITEMS, _CORPUS)} select query_id, doc_id, score, rank from bm",
    "index_statistics": r"""select term, count(distinct doc_id) as df from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as term
        from documents where source is distinct from 'src1') group by term""",
}

QUERIES = {n: globals()[n] for n in ORACLES}
