"""Operator 11: a Merkle manifest of a dataset, by a rollup of rank digits into nested structs.

Every row is a leaf; the leaves of each source make a ternary tree, and the sources' roots another, whose root stands for the
dataset. A node's rank among its tree's nodes, written to base 3, says where it goes: rows are grouped by tree and block of
3**DIGITS ranks (one shuffle), then the last digit is grouped away, then the next, each group becoming a struct of its hash and its
children. So a block is one nested struct of at most 3**DIGITS leaves, whatever a source's size. A block's root is a leaf of the
layer above, which is built the same way, until each source has one node. Coming down, a block meets the path of its root in a
group by block (a union, no join), one transform walks down the struct with the siblings of each run, and explode emits the proofs.

A proof is an array of (left, right), the hashes before and after the node in its run, joined; lowest run first. Folding it over a
leaf gives the root. Ranks come from one sort by range of all leaves: a row's place in its range less that of its source's first row
there, plus the source's rows in earlier ranges (a table with a row for each range and source in it; broadcast only when counted
small). No source's leaves come together in one task.

Defined cases: null ids come first in their source, null sources first of all; rows alike in all five fields are leaves of their own,
with equal hashes and paths of their own; rows with one id are ordered by their hashes; empty texts are values ('0:'), other than
nulls; a text of any length is hashed in its scan and goes nowhere; a source of one leaf has that leaf as its root; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, saved, table

BASE = 3
#: A block has 3**DIGITS nodes at most.
DIGITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*fields: Column) -> Column:
    """SHA-256 of the fields: '-' for null, else the length in bytes, ':' and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf hash of each row, with its text or another in its place."""
    return digest(*[F.col(f) for f in FIELDS[:-1]], F.col("text") if text is None else text)


def ranked(nodes: DataFrame, tree: str, *order: str) -> DataFrame:
    """Columns rank (from 0) and n of each row in its tree (null is one); written once, as places must not change with a retry."""
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    at = saved(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"at": F.monotonically_increasing_id(), "range": F.spark_partition_id()}), "leaves")
    here = at.groupBy(tree, "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(tree).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("rows").over(Window.partitionBy(tree))
    shift = here.select(tree, "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), whole.alias("n"))
    return join_small(at, shift, [tree, "range"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _run(children: Column, level: int) -> Column:
    """The struct of a run of nodes, a row of (d, node) each; trees that have one node by now stay as they are."""
    nodes = F.transform(F.array_sort(children), lambda x: x["node"])
    h = F.when(F.col("n") > BASE**level, F.sha2(F.array_join(F.transform(nodes, lambda x: x["h"]), ""), 256)).otherwise(nodes[0]["h"])
    return F.struct(h.alias("h"), nodes.alias("c"))


def blocks(nodes: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(tree, rank, n, h, p) -> a row (tree, block, n, node) for each block of 3**digits ranks: its nodes, nested run by run."""
    names = [f"d{k}" for k in range(digits)]
    digit = {f"d{k}": F.pmod(F.floor(F.col("rank") / BASE**k), F.lit(BASE)).cast("int") for k in range(digits)}
    out = nodes.select("tree", F.floor(F.col("rank") / BASE**digits).cast("long").alias("block"), "n", *[c.alias(k) for k, c in digit.items()], F.struct("h", "p").alias("node"))
    out = out.repartition("tree", "block")
    for k in range(digits):
        out = out.groupBy("tree", "block", "n", *names[k + 1 :]).agg(F.collect_list(F.struct(F.col(names[k]).alias("d"), "node")).alias("c"))
        out = out.select("tree", "block", "n", *names[k + 1 :], _run(F.col("c"), k).alias("node"))
    return out


def _siblings(children: Column, i: Column) -> Column:
    h = F.transform(children, lambda x: x["h"])
    return F.struct(F.array_join(F.slice(h, F.lit(1), i), "").alias("left"), F.array_join(F.slice(h, i + 2, F.lit(BASE)), "").alias("right"))


def _paths(node: Column, levels: int) -> Column:
    """Array of (h, p, proof) of the leaves below a node of so many levels."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    step = lambda i: F.when(F.col("n") > BASE ** (levels - 1), F.array(_siblings(node["c"], i))).otherwise(none)
    if levels == 1:
        return F.transform(node["c"], lambda x, i: F.struct(x["h"].alias("h"), x["p"].alias("p"), step(i).alias("proof")))
    down = lambda x, i: F.transform(_paths(x, levels - 1), lambda y: F.struct(y["h"].alias("h"), y["p"].alias("p"), F.concat(y["proof"], step(i)).alias("proof")))
    return F.flatten(F.transform(node["c"], down))


def _emitted(nested: DataFrame, up: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Blocks and (tree, block, above, tops) of their roots -> (tree, h, p, proof, tops) of their leaves, the block's path appended.

    The two meet in a group by block: each key has one row of either, so a first value is the value.
    """
    gap = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = nested.select("tree", "block", "n", "node", gap(up, "above").alias("above"), gap(up, "tops").alias("tops")).unionByName(
        up.select("tree", "block", gap(nested, "n").alias("n"), gap(nested, "node").alias("node"), "above", "tops")
    )
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "above", "tops")])
    out = met.select("tree", "above", "tops", F.explode(_paths(F.col("node"), digits)).alias("x"))
    return out.select("tree", F.col("x.h").alias("h"), F.col("x.p").alias("p"), F.concat("x.proof", "above").alias("proof"), "tops")


def grown(nodes: DataFrame, digits: int = DIGITS) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each layer over (tree, rank, n, h, p), and the roots (tree, h)."""
    layers = []
    while True:
        layers.append(saved(blocks(nodes, digits), "blocks"))
        width = BASE**digits
        up = layers[-1].select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / width).cast("long").alias("n"), F.col("node.h").alias("h"), F.col("block").alias("p"))
        if up.where("n > 1").isEmpty():
            return layers, up.select("tree", "h")
        nodes = up


def proven(layers: list[DataFrame], roots: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(tree, h, p, proof, tops) of the lowest layer's leaves. roots: (tree, above, tops), a root's own path and what to carry along."""
    up = roots.select("tree", F.lit(0).cast("long").alias("block"), "above", "tops")
    for k, nested in reversed(list(enumerate(layers))):
        out = _emitted(nested, up, digits)
        if k:
            up = out.select("tree", F.col("p").alias("block"), F.col("proof").alias("above"), "tops")
    return out


def manifest(rows: DataFrame, tree: str = "source", *order: str, digits: int = DIGITS) -> DataFrame:
    """rows with a leaf hash ``h`` -> their columns, subroot, root and proof (array of (left, right), lowest run first)."""
    payload = [c for c in rows.columns if c not in (tree, "h")]
    nodes = ranked(rows, tree, *order).select(F.col(tree).alias("tree"), "rank", "n", "h", F.struct(*payload).alias("p") if payload else F.lit(None).alias("p"))
    layers, subroots = grown(nodes, digits)
    # The trees' roots are the leaves of one more tree.
    top = ranked(subroots.select(F.lit(0).alias("one"), "tree", "h"), "one", "tree").select(F.col("one").alias("tree"), "rank", "n", "h", F.struct(F.col("tree").alias("of")).alias("p"))
    upper, root = grown(top, digits)
    seed = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("above"), F.col("h").alias("tops"))
    above = proven(upper, seed, digits).select(F.col("p.of").alias("tree"), F.col("proof").alias("above"), F.struct(F.col("h").alias("subroot"), F.col("tops").alias("root")).alias("tops"))
    out = proven(layers, above, digits)
    return out.select(F.col("tree").alias(tree), *[F.col(f"p.{c}").alias(c) for c in payload], "h", "tops.subroot", "tops.root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def tampered() -> Column:
    """The text of half of the rows without its line feeds; null for the others."""
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit("")))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    other = F.when(F.col("text").contains("\n") & tampered().isNotNull(), leaves(docs, tampered()))
    out = manifest(docs.select("source", "doc_id", leaves(docs).alias("h"), other.alias("other")), "source", "doc_id", "h")
    siblings = F.array_join(F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"]))), "")
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("other", "h"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_H = "sha256({})"
_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC_STEP = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint)), lambda c, b: {_CRC_STEP}), 4294967295)"

#: Levels by recursion; a run's nodes are hashed while its tree has more than one.
ORACLE = f"""with recursive
t as (select *, row_number() over () as row, case when doc_id is not null and {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as other from documents),
l as (select row, doc_id, source, {_H.format(_LEAF + " || " + _FIELD.format("text"))} as leaf, {_H.format(_LEAF + " || " + _FIELD.format("other"))} as changed from t),
r as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by source) as n from l),
lv as (select source, 0 as level, rank as idx, leaf as h, n from r
       union all
       select source, level + 1, idx // 3, {_H.format("string_agg(h, '' order by idx)")}, (n + 2) // 3 from lv where n > 1 group by source, level, idx // 3, n),
sr as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as rank, count(*) over () as n from lv where n = 1),
uv as (select 0 as level, rank as idx, subroot as h, n from sr
       union all
       select level + 1, idx // 3, {_H.format("string_agg(h, '' order by idx)")}, (n + 2) // 3 from uv where n > 1 group by level, idx // 3, n),
rt as (select h as root from uv where n = 1),
steps as (select row, lv.level as level, coalesce(string_agg(h, '' order by idx) filter (where idx < rank // p.f), '') as lt, coalesce(string_agg(h, '' order by idx) filter (where idx > rank // p.f), '') as rt
          from r join lv on lv.source is not distinct from r.source and lv.n > 1 join (select k, (3 ** k)::bigint as f from range(30) s(k)) p on p.k = lv.level
          where idx // 3 = (rank // p.f) // 3 group by row, lv.level
          union all
          select row, 1000 + uv.level, coalesce(string_agg(h, '' order by idx) filter (where idx < sr.rank // p.f), ''), coalesce(string_agg(h, '' order by idx) filter (where idx > sr.rank // p.f), '')
          from r join sr on sr.source is not distinct from r.source join uv on uv.n > 1 join (select k, (3 ** k)::bigint as f from range(30) s(k)) p on p.k = uv.level
          where idx // 3 = (sr.rank // p.f) // 3 group by row, uv.level),
pr as (select row, list(struct_pack(lt := lt, rt := rt) order by level) as proof, string_agg(lt || rt, '' order by level) as joined from steps group by row),
fo as (select r.row, 1 as k, changed as h, coalesce(proof, []) as proof from r left join pr using (row)
       union all select row, k + 1, {_H.format("proof[k].lt || h || proof[k].rt")}, proof from fo where k <= len(proof)),
fd as (select row, h as folded_root from fo where k = len(proof) + 1)
select doc_id, leaf, subroot, root, {_H.format("coalesce(joined, '')")} as proof_sha256, folded_root, folded_root = root as verified
from r join sr on sr.source is not distinct from r.source join fd using (row) left join pr using (row), rt"""
