"""Accounting over logs of provider calls: quotas, cache hits, fallback, diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small

CACHE_SECONDS = 300


def quota(calls: DataFrame, limits: DataFrame, unit: str = "yyyy-MM") -> DataFrame:
    """calls: ts, provider; limits: provider, monthly_limit -> used, remaining, available by period and provider."""
    used = calls.groupBy(F.date_format("ts", unit).alias("period"), "provider").agg(F.count("*").alias("used"))
    out = used.join(small(limits), "provider", "left")
    return out.withColumns({"remaining": F.greatest(F.lit(0), F.col("monthly_limit") - F.col("used")), "available": F.col("used") < F.col("monthly_limit")})


def cache_hits(calls: DataFrame, key: str, seconds: int = CACHE_SECONDS, order: str = "seq") -> DataFrame:
    """Mark calls that find the last call of the same key not older than ``seconds``: age, hit.

    Every call refreshes the entry. The window is by key and sorted; it keeps one row at a time.
    """
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", order))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age = micros(F.col("ts")) - micros(before)
    return calls.withColumn("age", (age / 1e6).cast("double")).withColumn("hit", F.coalesce(F.col("age") <= seconds, F.lit(False)))


def first_answer(calls: DataFrame, request: str, priority: dict[str, int]) -> DataFrame:
    """calls: request, provider, eligible, n_results -> the provider whose answer counts: the first by priority that is
    eligible and not empty; ``tried`` is the number of eligible providers up to it (all, if none answers)."""
    order = F.lit(None).cast("int")
    for p, n in priority.items():
        order = F.when(F.col("provider") == p, n).otherwise(order)
    c = calls.withColumn("priority", order).where(F.col("priority").isNotNull() & F.col("eligible"))
    won = c.groupBy(request).agg(F.min(F.when(F.col("n_results") > 0, F.col("priority"))).alias("won"), F.collect_set("priority").alias("all"))
    tried = F.when(F.col("won").isNull(), F.size("all")).otherwise(F.size(F.filter("all", lambda x: x <= F.col("won"))))
    name = F.lit(None).cast("string")
    for p, n in priority.items():
        name = F.when(F.col("won") == n, F.lit(p)).otherwise(name)
    return won.select(request, name.alias("provider"), tried.cast("long").alias("tried"))


def diagnostics(calls: DataFrame, n: int = 50) -> DataFrame:
    """The last n calls."""
    return calls.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def by_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def search(chain: list[tuple[str, Callable]], query: str, count: int, allowed: Callable[[str], bool]) -> dict:
    """One federated search on the driver: the first provider that is allowed and answers wins; errors are kept."""
    errors = {}
    for name, call in chain:
        if not allowed(name):
            errors[name] = "not available"
            continue
        try:
            results = call(query, count)
        except Exception as e:  # a provider's failure is an answer of its own
            errors[name] = str(e)
            continue
        if results:
            return {"provider": name, "count": len(results), "results": [{"title": r.get("title", ""), "url": r.get("url", ""), "snippet": (r.get("snippet") or "")[:300]} for r in results], "errors": errors}
    return {"provider": None, "count": 0, "results": [], "errors": errors}
