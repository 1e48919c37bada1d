"""Mixtures of sources by target shares of tokens.

Each source gets a budget: its share of the total. Whole passes over a source are taken while they fit; what
is left of its budget is fitted by subset sums over the number of documents of each exact token length, and
documents are then picked by a seeded order within their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from .byte_bpe import DEFAULT_VOCABULARY, token_counts

#: Tokens of a budget that are left to the exact fit; the rest is filled in proportion to the lengths.
EXACT_SPAN = 1 << 16
#: Parts of a length's documents that are counted before any is ranked.
PARTS = 4096


def fit_counts(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many documents of each length to take so that their sum comes as near below ``budget`` as can be.

    A proportional part of every length is taken, then single documents in a seeded order of lengths until no
    more than the exact span is left (at least four of the longest); the rest is a bounded knapsack: counts
    are split in powers of two and reachable sums are the bits of an integer.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(lengths)
    span = max(EXACT_SPAN, 4 * max(lengths))
    near = max(0, budget - span)
    taken = [c * near // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda k: hash((seed, lengths[k])))
    while left > span:
        before = left
        for k in order:
            if left <= span:
                break
            if taken[k] < counts[k]:
                more = max(1, (counts[k] - taken[k]) // 64)
                more = min(more, (left - span) // lengths[k] + 1)
                taken[k] += more
                left -= more * lengths[k]
        if left == before:
            break
    if left < 0:
        raise AssertionError("the span is at least four times the longest document")
    # By which step each sum was reached first: one number a sum, however many steps there are.
    reached, first, steps = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int32), []
    reached[0] = True
    for k in order:
        free, part = counts[k] - taken[k], 1
        while free > 0 and not reached[left]:
            part = min(part, free)
            size = part * lengths[k]
            if size <= left:
                new = np.flatnonzero(reached[: left + 1 - size] & ~reached[size:]) + size
                first[new], reached[new] = len(steps), True
                steps.append((size, k, part))
            free -= part
            part *= 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        size, k, part = steps[first[at]]
        taken[k] += part
        at -= size
    return taken


def mixture(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str = DEFAULT_VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(picked, shares).

    picked: source, doc_id, n_tokens, copies; one row per document used, copies from 1 to its source's cap.
    shares: source, target_share, max_repeats, docs_available, tokens_available, target_tokens, actual_tokens,
    docs_used, actual_share, short_by (tokens), binds; one row per source of ``targets``, also where nothing is there.
    ``binds`` tells which source keeps the total from being larger; none does where the total is given.

    Without ``total_tokens`` the total is the largest at which every source that has any tokens and a cap
    above 0 meets its target. A source without tokens or with cap 0 gets nothing and is reported as short of its whole target; the others'
    budgets stay target_share of the total. Documents of no target source, without source or without tokens
    are not used; a null share or cap counts as 0; a source named twice in ``targets`` has its shares added
    and its lowest cap. A null doc_id is a document like any other.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.sum(F.coalesce(F.col("target_share"), F.lit(0.0))).cast("double").alias("target_share"),
        F.min(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))).cast("bigint").alias("max_repeats"),
    )
    mine = documents.select("doc_id", "source", "text").join(small(wanted.select("source")), "source", "left_semi")
    # Tokenised once; three narrow columns are kept, a part number of each document among them.
    sized = cut(
        token_counts(mine, ["doc_id", "source"], path=path)
        .where("n_tokens > 0")
        .withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int"))
    )
    spread = cut(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")))
    have = spread.groupBy("source").agg(F.sum("docs").alias("docs_available"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens_available"))
    stock = wanted.join(have, "source", "left").fillna(0, ["docs_available", "tokens_available"])
    usable = (F.col("tokens_available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    stock = stock.withColumn("reach", F.when(usable, F.floor(F.try_divide(F.col("tokens_available") * F.col("max_repeats"), F.col("target_share")))))
    if total_tokens is None:
        whole = stock.agg(F.min("reach").alias("total"))
    else:
        whole = spark.range(1).select(F.lit(int(total_tokens)).cast("bigint").alias("total"))
    # One row per source of the targets.
    plan = cut(
        stock.join(F.broadcast(whole.select(F.coalesce("total", F.lit(0)).alias("total"))), F.lit(True), "left")
        .withColumn("target_tokens", F.round(F.col("total") * F.col("target_share")).cast("bigint"))
        .withColumn("budget", F.least("target_tokens", F.col("tokens_available") * F.col("max_repeats")))
        .withColumn("passes", F.coalesce(F.floor(F.try_divide("budget", "tokens_available")), F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens_available"))
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        take = fit_counts(pdf["n_tokens"].tolist(), pdf["docs"].tolist(), int(pdf["rest"].iloc[0]), seed)
        return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "passes": pdf["passes"], "take": take})

    # A group is the spread of one source: a row per distinct length, however many documents there are.
    taken = cut(
        spread.join(plan.select("source", "passes", "rest"), "source")
        .groupBy("source")
        .applyInPandas(fit, "source string, n_tokens bigint, passes bigint, take bigint")
    )
    # Whole parts of a length are taken while they fit in; only the part on the edge is ranked row by row.
    by_part = sized.join(taken.where("take > 0").select("source", "n_tokens"), ["source", "n_tokens"], "left_semi")
    parts = by_part.groupBy("source", "n_tokens", "part").agg(F.count(F.lit(1)).alias("docs"))
    upto = F.sum("docs").over(Window.partitionBy("source", "n_tokens").orderBy("part"))
    edges = (
        parts.withColumn("upto", upto)
        .join(taken.where("take > 0"), ["source", "n_tokens"])
        .select("source", "n_tokens", "part", F.greatest(F.lit(0), F.least("docs", F.col("take") - F.col("upto") + F.col("docs"))).alias("here"), "docs")
        .where("here > 0")
    )
    drawn = by_part.join(edges, ["source", "n_tokens", "part"])
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("draw", "doc_id"))
    extra = drawn.where("here = docs").select("source", "doc_id", "n_tokens").unionByName(
        drawn.where("here < docs").withColumn("rank", rank).where("rank <= here").select("source", "doc_id", "n_tokens")
    )
    full = sized.join(small(plan.where("passes > 0").select("source", "passes")), "source").select("source", "doc_id", "n_tokens", "passes")
    picked = (
        full.withColumnRenamed("passes", "copies")
        .unionByName(extra.withColumn("copies", F.lit(1).cast("bigint")))
        .groupBy("source", "doc_id", "n_tokens")
        .agg(F.sum("copies").alias("copies"))
    )
    used = taken.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("take")).alias("extra_tokens"), F.sum("take").alias("extra_docs")
    )
    reached = (
        plan.join(used, "source", "left")
        .withColumn("actual_tokens", F.col("passes") * F.col("tokens_available") + F.coalesce("extra_tokens", F.lit(0)))
        .withColumn("docs_used", F.when(F.col("passes") > 0, F.col("docs_available")).otherwise(F.coalesce("extra_docs", F.lit(0))))
    )
    everything = reached.agg(F.sum("actual_tokens").alias("everything"))
    shares = reached.join(F.broadcast(everything), F.lit(True), "left").select(
        "source", "target_share", "max_repeats", "docs_available", "tokens_available", "target_tokens", "actual_tokens", "docs_used",
        F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.col("everything")), F.lit(0.0)).alias("actual_share"),
        (F.col("target_tokens") - F.col("actual_tokens")).alias("short_by"), (F.lit(total_tokens is None) & F.coalesce(F.col("reach") == F.col("total"), F.lit(False))).alias("binds"),
    )
    return picked, shares
