"""Words of text that has no blanks between them, by a dictionary table of any size.

The dictionary is joined, not held in a task: each run of characters is exploded into its substrings up to the longest word, which meet the
dictionary in an equi-join; what matches are the edges of the run's word graph. The best path, the one of greatest probability, is a fold
over the run's places from right to left; characters that no word covers are words of one character, seen once. In search mode the words of two and
then three characters inside a longer word are given, too, before it. Equal runs are worked on once.

Defined cases: null and empty texts have no words; of paths alike the one whose first word is longer is taken; a word that the dictionary
has more than once counts by the sum of its frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

#: What is cut by the dictionary: runs of Han characters; other letters and digits are words as they stand.
HAN = r"\p{IsHan}+"


def runs_of(c: Column, pattern: str) -> Column:
    """Runs of letters and digits, in order, those of ``pattern`` apart from others: array of (text, cut)."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"({pattern}|(?:(?!{pattern})[\p{{L}}\p{{N}}])+)"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.regexp_like(x, F.lit(rf"^{pattern}$")).alias("cut")))


def best_path(edges: Column, n: Column, floor: Column) -> Column:
    """Word lengths of the best path over n characters. edges: array of (at, size, weight), weight a log probability; ``floor`` is that of a character that no edge covers."""
    state = "array<struct<score:double,size:int>>"

    def step(done, at):
        # done[k] is the best path from place at + 1 + k on.
        own = F.filter(edges, lambda e: e["at"] == at)
        own = F.when(F.exists(own, lambda e: e["size"] == 1), own).otherwise(F.concat(own, F.array(F.struct(at.alias("at"), F.lit(1).alias("size"), floor.alias("weight")))))
        ways = F.transform(own, lambda e: F.struct((e["weight"] + F.when(e["size"] > F.size(done), 0.0).otherwise(F.get(done, e["size"] - 1)["score"])).alias("score"), e["size"].alias("size")))
        return F.concat(F.array(F.array_max(ways)), done).cast(state)

    places = F.when(n > 0, F.reverse(F.sequence(F.lit(0), n - 1))).otherwise(F.array().cast("array<int>"))
    best = F.aggregate(places, F.array().cast(state), step)
    # From left to right: each place that the last word ends at opens the next one.
    walk = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("sizes"))
    take = lambda a, at: F.when(at == a["next"], F.struct((at + F.get(best, at)["size"]).alias("next"), F.concat(a["sizes"], F.array(F.get(best, at)["size"])).alias("sizes"))).otherwise(a)
    return F.aggregate(F.reverse(places), walk.cast("struct<next:int,sizes:array<int>>"), lambda a, at: take(a, at).cast("struct<next:int,sizes:array<int>>"), lambda a: a["sizes"])


def segmented_runs(runs: DataFrame, dictionary: DataFrame, search: bool = True) -> DataFrame:
    """(run, words) of each different run; dictionary: word, freq."""
    known = dictionary.where("word <> '' and freq > 0").groupBy("word").agg(F.sum("freq").cast("double").alias("freq"))
    about = known.agg(F.coalesce(F.sum("freq"), F.lit(1.0)).alias("total"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest")).first()
    runs = runs.select("run").where("run <> ''").distinct().withColumn("n", F.length("run"))
    starts = runs.select("run", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    sizes = starts.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(about["longest"]), F.col("n") - F.col("at")))).alias("size"))
    parts = sizes.withColumn("word", F.substring("run", F.col("at") + 1, F.col("size")))
    edge = F.struct("at", "size", F.log(F.col("freq") / about["total"]).alias("weight"))
    graph = parts.join(small(known), "word").groupBy("run").agg(F.array_sort(F.collect_list(edge)).alias("edges"))  # of one run each
    floor = F.lit(1.0 / about["total"])
    path = runs.join(graph, "run", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<at:int,size:int,weight:double>>")))
    path = path.withColumn("sizes", best_path(F.col("edges"), F.col("n"), F.log(floor)))
    ends = F.transform("sizes", lambda s, i: F.struct((F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x)).alias("at"), s.alias("size")))
    there = lambda at, size: F.exists("edges", lambda e: (e["at"] == at) & (e["size"] == size))

    def inner(w, size: int) -> Column:
        """Words of so many characters inside a longer one."""
        places = F.when(w["size"] > size, F.sequence(w["at"], w["at"] + w["size"] - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(places, lambda at: there(at, F.lit(size))), lambda at: F.substring("run", at + 1, F.lit(size)))

    whole = lambda w: F.array(F.substring("run", w["at"] + 1, w["size"]))
    words = F.transform("ends", lambda w: F.concat(inner(w, 2), inner(w, 3), whole(w)) if search else whole(w))
    return path.withColumn("ends", ends).select("run", F.flatten(words).alias("words"))


def segmented(rows: DataFrame, key: str, text: str, dictionary: DataFrame, search: bool = True, pattern: str = HAN) -> DataFrame:
    """(key, words) of every row: lower-cased runs of letters and digits in order, those of ``pattern`` cut into words."""
    parts = rows.select(key, F.posexplode(runs_of(F.col(text), pattern)).alias("pos", "r")).select(key, "pos", F.col("r.text").alias("run"), F.col("r.cut").alias("cut"))
    cut = segmented_runs(parts.where("cut"), dictionary, search)
    met = parts.join(small(cut), "run", "left").select(key, "pos", F.when(F.col("cut"), F.col("words")).otherwise(F.array("run")).alias("words"))
    gathered = met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "words"))).alias("w")).select(F.col(key).alias("__key"), F.flatten(F.transform("w", lambda x: x["words"])).alias("words"))  # of one row's text each
    out = rows.select(key).join(gathered, F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(key, F.coalesce("words", F.array().cast("array<string>")).alias("words"))
