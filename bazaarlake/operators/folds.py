"""Upserts as ordered folds over change logs.

A log has a key and an order; the order's columns together must be unique within a key, or results among
equals are those of the greatest values. Aggregates combine before the shuffle, so a hot key is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def last(name: str, order: list[str]) -> Column:
    """The last value, be it null."""
    return F.max_by(F.struct(name), _order(order))[name].alias(name)


def last_known(name: str, order: list[str]) -> Column:
    """The last value that is not null."""
    return F.max_by(name, F.when(F.col(name).isNotNull(), _order(order))).alias(name)


def first(name: str, order: list[str]) -> Column:
    """The first value, be it null."""
    return F.min_by(F.struct(name), _order(order))[name].alias(name)


def upserted(log: DataFrame, key: list[str], order: list[str], last_wins: list[str] = (), known_wins: list[str] = (), first_wins: list[str] = (), counts: dict[str, Column] | None = None) -> DataFrame:
    """The state that a log of upserts leaves: one row per key.

    ``last_wins`` are overwritten by each row, ``known_wins`` by each row that tells them, ``first_wins`` are
    set once; ``counts`` are numbers of rows for which a condition holds. Null keys are keys.
    """
    return log.groupBy(*key).agg(
        *(last(n, order) for n in last_wins),
        *(last_known(n, order) for n in known_wins),
        *(first(n, order) for n in first_wins),
        *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in (counts or {}).items()),
    )


def merged_json(log: DataFrame, key: list[str], order: list[str], patch: str) -> DataFrame:
    """(key, patch): the shallow merge of JSON objects in their order, later values first; as text with sorted keys.

    Patches are split to keys and folded key by key, so a long log of one entity never meets in one row.
    """
    single = log.where(F.col(patch).isNotNull()).select(*key, *order, F.explode(F.from_json(patch, "map<string,variant>")).alias("__bl_k", "__bl_v"))
    state = single.select(*key, *order, "__bl_k", F.to_json(F.struct(F.col("__bl_v").alias("v"))).alias("__bl_j")).groupBy(*key, "__bl_k").agg(F.max_by("__bl_j", _order(order)).alias("__bl_j"))
    pair = F.concat(F.to_json(F.array("__bl_k")), F.lit(":"), F.regexp_extract("__bl_j", r'^\{"v":(.*)\}$', 1))
    shown = F.regexp_replace(pair, r'^\["(.*?)"\]:', '"$1":')
    return state.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__bl_k", shown.alias("__bl_p")))).alias("__bl_a")).select(
        *key, F.concat(F.lit("{"), F.array_join(F.transform("__bl_a", lambda x: x["__bl_p"]), ","), F.lit("}")).alias(patch)
    )


def split_second_owner(log: DataFrame, key: str, owner: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows of the key that came first for an owner, and those of its later keys.

    Each owner may have one key only; every row of a later key is rejected.
    """
    began = log.groupBy(*owner, key).agg(F.min(_order(order)).alias("__bl_began"))
    chosen = began.groupBy(*owner).agg(F.min_by(key, F.struct("__bl_began", key)).alias(key))
    return log.join(chosen, [*owner, key], "left_semi"), log.join(chosen, [*owner, key], "left_anti")


def unseen(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is not known yet: each such key once, its first row by ``pos``; null and empty keys go."""
    fresh = batch.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).join(known.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min("pos").alias("pos"))


def claimed(queue: DataFrame, n: int, status: str = "status", pending: str = "pending", order: list[str] = ("enqueued_at", "id")) -> DataFrame:
    """The first ``n`` pending rows, in order: a distributed top-n, not a sort."""
    return queue.where(F.col(status) == pending).orderBy(*order).limit(n)


def claimed_per(queue: DataFrame, n: int, group: str, status: str = "status", pending: str = "pending", order: list[str] = ("enqueued_at", "id")) -> DataFrame:
    """The first ``n`` pending rows of each group; groups are cut as they sort, so a hot group sends few rows on."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return queue.where(F.col(status) == pending).withColumn("__bl_n", place).where(F.col("__bl_n") <= n).drop("__bl_n")


def job_states(log: DataFrame, key: str, status: str, order: list[str], at: str) -> DataFrame:
    """(key, status, attempts, claimed_at, completed_at): what a log of pending, claimed, done, failed and retried leaves.

    A job is as its last event says, pending again after retried and as long as nothing but pending was said. A
    retry takes away when it was claimed and ended before; attempts are all claims. Two aggregates, each combined
    before its shuffle, so a job with a third of all events is no hot task.
    """
    what = F.col(status)
    reset = log.where(what == "retried").groupBy(key).agg(F.max(_order(order)).alias("__bl_reset"))
    after = F.col("__bl_reset").isNull() | (_order(order) > F.col("__bl_reset"))
    folded = log.join(reset, key, "left").groupBy(key).agg(
        F.max_by(status, F.when(what != "pending", _order(order))).alias("__bl_s"), F.count_if(what == "claimed").alias("attempts"),
        F.max(F.when((what == "claimed") & after, F.col(at))).alias("claimed_at"), F.max(F.when(what.isin("done", "failed") & after, F.col(at))).alias("completed_at"),
    )
    return folded.select(key, F.coalesce(F.nullif("__bl_s", F.lit("retried")), F.lit("pending")).alias("status"), "attempts", "claimed_at", "completed_at")


def stale_claims(jobs: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Jobs (status, claimed_at) that were claimed more than ``ttl_seconds`` before a moment and never ended; such may be retried."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("claimed_at").cast("timestamp"))
    return jobs.where((F.col("status") == "claimed") & (age > ttl_seconds))


def latest_status(events: DataFrame, key: str, status: str, order: list[str], since: str) -> DataFrame:
    """(key, status, attempts, changed_at): the state that a log of events leaves; attempts are claims."""
    return events.groupBy(key).agg(F.max_by(status, _order(order)).alias("status"), F.count_if(F.col(status) == "claimed").alias("attempts"), F.max(since).alias("changed_at"))


def orphaned(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children that a cascading delete would take: those whose parent is not there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def runs(events: DataFrame, key: str, order: list[str], hit: Column, period: Column | None = None) -> DataFrame:
    """(key, run, length, begins, ends): runs of consecutive hits of each key, numbered from 1.

    With ``period``, which must grow with the order (a month of its time, say), events meet row by row within a period
    only; runs that touch its ends are put together from a row per key and period, so a key with a third of all
    events is many tasks. Without it a key's events are sorted in one task.
    """
    marked = events.withColumn("__bl_hit", F.coalesce(hit, F.lit(False))).withColumn("__bl_p", F.lit(0) if period is None else period)
    w = Window.partitionBy(key, "__bl_p").orderBy(*order)
    isles = marked.withColumn("__bl_island", F.sum((~F.col("__bl_hit")).cast("int")).over(w))
    pieces = isles.where("__bl_hit").groupBy(key, "__bl_p", "__bl_island").agg(F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("begins"), F.max(order[0]).alias("ends"))
    # Between two periods runs go on; a period with any miss ends the chain that it begins with and begins another.
    misses = marked.groupBy(key, "__bl_p").agg(F.count_if(~F.col("__bl_hit")).alias("__bl_misses"))
    before = Window.partitionBy(key).orderBy("__bl_p").rowsBetween(Window.unboundedPreceding, -1)
    chained = misses.withColumn("__bl_chain", F.coalesce(F.sum((F.col("__bl_misses") > 0).cast("int")).over(before), F.lit(0)))
    chain = F.when(F.col("__bl_island") == 0, F.col("__bl_chain")).when(F.col("__bl_island") == F.col("__bl_misses"), F.col("__bl_chain") + 1)
    placed = pieces.join(chained.withColumnRenamed(key, "__bl_k"), pieces[key].eqNullSafe(F.col("__bl_k")) & (pieces["__bl_p"] == chained["__bl_p"])).select(
        pieces[key], "length", "begins", "ends", chain.alias("__bl_chain"), F.when(chain.isNull(), F.struct(pieces["__bl_p"], "__bl_island")).alias("__bl_inner")
    )
    found = placed.groupBy(key, "__bl_chain", "__bl_inner").agg(F.sum("length").alias("length"), F.min("begins").alias("begins"), F.max("ends").alias("ends"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(key).orderBy("begins", "ends")).cast("bigint")).drop("__bl_chain", "__bl_inner")


def changes(log: DataFrame, key: list[str], order: list[str], value: str, flag: str, period: Column, least: float = 0.01) -> DataFrame:
    """Rows of a log that differ from the one before of their key: a value more than ``least`` off, or another flag.

    ``period`` must grow with the order (a month of its time, say). Rows meet row by row within a period only;
    across periods a row per key and period is handed on, so a key with a third of the log is many tasks.
    The order must be unique within a key; the first row of a key is no change.
    """
    at = log.withColumn("__bl_p", period)
    w = Window.partitionBy(*key, "__bl_p").orderBy(*order)
    closing = at.groupBy(*key, "__bl_p").agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(flag).alias("f")), _order(order)).alias("__bl_c"))
    handed = closing.select(*key, "__bl_p", F.lag("__bl_c").over(Window.partitionBy(*key).orderBy("__bl_p")).alias("__bl_h"))
    here = F.lag(F.struct(F.col(value).alias("v"), F.col(flag).alias("f"))).over(w)
    before = at.join(handed, [*key, "__bl_p"]).withColumn("__bl_b", F.coalesce(here, "__bl_h"))
    news = (F.abs(F.col(value) - F.col("__bl_b.v")) > least) | ~F.col(flag).eqNullSafe(F.col("__bl_b.f"))
    return before.where(F.col("__bl_b").isNotNull() & F.coalesce(news, F.lit(False))).withColumn(f"{value}_before", F.col("__bl_b.v")).drop("__bl_p", "__bl_h", "__bl_b")
