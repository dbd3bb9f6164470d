"""Texts packed whole into containers of fixed capacity, by bulk-synchronous best fit.

Texts and gaps are sorted by size.  In each round all texts of the largest
size left are matched at once with their successor gaps, the smallest that
hold them; which text of the size gets which container follows from its rank;
the gaps are updated and the next size follows.  As sizes and gaps are whole
numbers up to the capacity, the rounds run over runs of equal sizes and equal
gaps, so their cost is bounded by the capacity and not by the number of texts;
the outcome is that of best fit in decreasing order.  The texts themselves
stay distributed: they are ranked within their size, salted, and joined by
size and rank with the places that the runs stand for.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.plans.tables import materialise, salted_rank

MOST_BUDGETS = 1000
PLACES_PER_ROW = 65_536  # of a run that one row makes
RUNS = "budget_id int, size long, rank_from long, rank_to long, container_from long, per_container long"


def best_fit_runs(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, rank_from, rank_to, container_from, per_container) for (size, count) pairs.

    The texts of a size with ranks [rank_from, rank_to) go, ``per_container``
    at a time, into consecutive containers from ``container_from`` on.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # distinct gaps, ascending
    bins: dict[int, list[list[int]]] = {}  # gap -> [first container, how many]
    opened = 0

    def give(gap: int, first: int, n: int) -> None:
        if n:
            if gap not in bins:
                bisect.insort(gaps, gap)
                bins[gap] = []
            bins[gap].append([first, n])

    for size, left in sorted(counts, reverse=True):
        at = 0
        if size == 0:  # takes no room: the first container holds them all
            opened = max(opened, 1)
            runs.append((0, 0, left, 0, left))
            continue
        while left:
            i = bisect.bisect_left(gaps, size)
            if i == len(gaps):
                per = capacity // size
                n = -(-left // per)
                give(capacity, opened, n)
                opened += n
                i = bisect.bisect_left(gaps, size)
            gap = gaps[i]
            first, n = bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(i)
            per = gap // size
            whole = min(n, left // per)
            if whole:
                runs.append((size, at, at + whole * per, first, per))
                at, left = at + whole * per, left - whole * per
                give(gap - per * size, first, whole)
            if whole < n and left:
                runs.append((size, at, at + left, first + whole, left))
                give(gap - left * size, first + whole, 1)
                at, left, whole = at + left, 0, whole + 1
            give(gap, first + whole, n - whole)
    return runs


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    budget, capacity = int(pdf["budget_id"].iloc[0]), int(pdf["capacity"].iloc[0])
    runs = best_fit_runs([(int(s), int(n)) for s, n in zip(pdf["size"], pdf["n"])], capacity)
    return pd.DataFrame([(budget, *r) for r in runs], columns=["budget_id", "size", "rank_from", "rank_to", "container_from", "per_container"])


def pack(sizes: DataFrame, budgets: DataFrame, salts: int = 16) -> DataFrame:
    """(budget_id, doc_id, piece, n_tokens, container): where each text lies for each capacity.

    ``sizes`` has doc_id and n_tokens, ``budgets`` budget_id and capacity (at
    most ``MOST_BUDGETS`` rows).  A text larger than the capacity is split into
    pieces that fill a container each, and a rest that is packed like a text;
    all others have one piece, 0.  A text without tokens lies in container 0.
    A repeated doc_id counts once, with its largest size; rows without doc_id,
    and budgets without an id or a positive capacity, are ignored.  Containers
    are numbered from 0 for each budget without holes.
    """
    rows = budgets.where("budget_id IS NOT NULL AND capacity > 0").groupBy("budget_id").agg(F.max("capacity").alias("capacity")).limit(MOST_BUDGETS + 1).collect()
    if len(rows) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    spark = sizes.sparkSession
    if not rows:
        return spark.createDataFrame([], "budget_id int, doc_id long, piece long, n_tokens long, container long")
    texts = materialise(sizes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens")))

    each = F.explode(F.array(*[F.struct(F.lit(int(r.budget_id)).alias("budget_id"), F.lit(int(r.capacity)).cast("long").alias("capacity")) for r in sorted(rows)]))
    wanted = texts.select("doc_id", "n_tokens", each.alias("b")).select("doc_id", "n_tokens", "b.budget_id", "b.capacity")
    split = F.col("n_tokens") > F.col("capacity")
    parts = wanted.select("*", F.when(split, F.expr("n_tokens div capacity")).otherwise(F.lit(0)).cast("long").alias("full"), F.when(split, F.col("n_tokens") % F.col("capacity")).otherwise(F.col("n_tokens")).alias("size"))
    items = parts.where((F.col("full") == 0) | (F.col("size") > 0)).select("budget_id", "capacity", "doc_id", "full", "size")

    histogram = items.groupBy("budget_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = materialise(histogram.groupBy("budget_id").applyInPandas(_plan, RUNS))
    # a run of any length is cut before its places are made, one for each text
    cut = runs.select("*", F.explode(F.expr(f"sequence(rank_from, rank_to - 1, {PLACES_PER_ROW}L)")).alias("at")).repartition("budget_id", "size", "at")
    rank = F.explode(F.expr(f"sequence(at, least(at + {PLACES_PER_ROW}L, rank_to) - 1)"))
    places = cut.select("budget_id", "size", "rank_from", "container_from", "per_container", rank.alias("rank"))
    places = places.select("budget_id", "size", "rank", F.expr("container_from + (rank - rank_from) div per_container").alias("container"))
    ranked = salted_rank(items.drop("capacity"), ["budget_id", "size"], ["doc_id"], "rank", salts)
    met = ranked.join(places.hint("merge"), ["budget_id", "size", "rank"])
    whole = met.select("budget_id", "doc_id", F.col("full").alias("piece"), F.col("size").alias("n_tokens"), "container")

    # pieces that fill a container alone come after the others
    large = parts.where("full > 0").select("budget_id", "capacity", "doc_id", "full")
    starts = runs.groupBy(F.col("budget_id").alias("b_")).agg(F.max(F.expr("container_from + (rank_to - rank_from + per_container - 1) div per_container")).alias("opened"))
    numbered = salted_rank(large, ["budget_id"], ["doc_id"], "before", 4 * salts, weight="full").join(starts, F.col("budget_id") == F.col("b_"), "left")
    alone = numbered.select("budget_id", "doc_id", "capacity", (F.coalesce("opened", F.lit(0)) + F.col("before")).alias("from"), F.explode(F.expr("sequence(0L, full - 1)")).alias("piece"))
    alone = alone.select("budget_id", "doc_id", "piece", F.col("capacity").alias("n_tokens"), (F.col("from") + F.col("piece")).alias("container"))
    return whole.unionByName(alone)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, capacity, containers, least, n_tokens, unused) of each budget.

    least is the number of containers that no packing can be below, by the sum of the sizes;
    unused is the share of empty room.
    """
    used = packed.groupBy("budget_id", "container").agg(F.sum("n_tokens").alias("t")).groupBy("budget_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("n_tokens"))
    caps = budgets.groupBy(F.col("budget_id").alias("b_")).agg(F.max("capacity").alias("capacity"))
    both = used.join(caps, F.col("budget_id") == F.col("b_"))
    return both.select("budget_id", "capacity", "containers", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least"), "n_tokens", (1 - F.col("n_tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))
