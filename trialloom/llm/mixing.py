"""Sources mixed to target weights by a low-discrepancy schedule.

A mixture is a row of slots of equally many tokens.  The van der Corput point
of a slot's number, put through the cumulative weights, gives its source; the
slots of a source are ranked, and the r-th takes the r-th block of the
source's stream: its documents in shuffled order, once for every repetition,
cut into blocks of the same number of tokens.  A document belongs to the
block in which it begins, and is never cut.

Slots are made by chunk; how many slots of a source lie before a chunk follows
from the digits of its number, so chunks know nothing of one another.  The
positions in the stream are prefix sums over chunks.  A source or mixture of
any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.plans.tables import materialise

BLOCK_TOKENS = 1024  # size of a block
DOCS_PER_CHUNK = 50_000
SLOTS_PER_CHUNK = 65_536
MOST_TASKS = 10_000  # that make slots; beyond, a task makes several chunks
BITS = 52


def van_der_corput(i: np.ndarray) -> np.ndarray:
    """The point in [0, 1) whose binary digits are those of ``i`` mirrored, as a whole number of 2^-BITS."""
    i = np.asarray(i, np.int64)
    out = np.zeros_like(i)
    for k in range(BITS):
        out |= ((i >> k) & 1) << (BITS - 1 - k)
    return out


def slots_before(n: int, points: np.ndarray) -> np.ndarray:
    """How many of the first ``n`` slots have a van der Corput point below each of ``points`` (in units of 2^-BITS).

    The numbers below n are aligned ranges of 2^k, one for each digit 1 of n; the points of
    such a range are evenly spaced, 2^(BITS - k) apart.
    """
    out = np.zeros(len(points), np.int64)
    at = 0
    for k in reversed(range(BITS)):
        if n >> k & 1:
            apart = 1 << (BITS - k)
            out += np.clip(-(-(points - van_der_corput(at)) // apart), 0, 1 << k)
            at += 1 << k
    return out


def streams(sizes: DataFrame, repeats: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, repetition, start): where each document begins in its source's shuffled stream.

    ``repeats`` gives each source's repetitions; every one is shuffled anew,
    and follows the one before it.
    """
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
    s = stats.join(repeats, "source").select(F.col("source").alias("s_"), "n", "total", "repeats")
    each = sizes.join(s, F.col("source") == F.col("s_")).select("source", "doc_id", "n_tokens", "n", "total", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("repetition"))
    shuffled = each.withColumn("place", F.xxhash64("doc_id", "repetition"))
    chunk = F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / DOCS_PER_CHUNK)).cast("int")
    chunked = shuffled.withColumn("chunk", chunk)
    totals = chunked.groupBy(F.col("source").alias("s_"), F.col("repetition").alias("r_"), F.col("chunk").alias("c_")).agg(F.sum("n_tokens").alias("t"))
    earlier = W.partitionBy("s_", "r_").orderBy("c_").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("s_", "r_", "c_", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("from"))
    inner = W.partitionBy("source", "repetition", "chunk").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    local = chunked.withColumn("local", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    on = (F.col("source") == F.col("s_")) & (F.col("repetition") == F.col("r_")) & (F.col("chunk") == F.col("c_"))
    # a row for 50,000 documents: it grows with the table, so it is never broadcast
    return local.join(before.hint("merge"), on).select("source", "doc_id", "n_tokens", "repetition", (F.col("repetition") * F.col("total") + F.col("from") + F.col("local")).alias("start"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for mix_id, chunk, slots, bounds in zip(*(batch.column(i).to_pylist() for i in range(4))):
            first = chunk * SLOTS_PER_CHUNK
            slot = np.arange(first, min(slots, first + SLOTS_PER_CHUNK))
            lo = np.rint([x["lo"] * 2.0**BITS for x in bounds]).astype(np.int64)
            edges = np.append(lo, 1 << BITS)
            ranks = np.diff(slots_before(first, edges))
            source = np.searchsorted(lo, van_der_corput(slot), "right") - 1
            order = np.argsort(source, kind="stable")
            n = np.bincount(source, minlength=len(bounds))
            rank = np.empty(len(slot), np.int64)
            rank[order] = np.arange(len(slot)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ranks, n)
            names = pa.array([x["source"] for x in bounds], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), mix_id), batch.schema.field(0).type), names.take(pa.array(source)), pa.array(slot), pa.array(rank)], ["mix_id", "source", "slot", "rank"])


def schedule(targets: DataFrame) -> DataFrame:
    """(mix_id, source, slot, rank): the source of each slot, and the slot's rank among those of its source.

    ``targets`` has mix_id, source, the bounds lo and hi of its cumulative
    weight, and the mixture's number of slots.
    """
    mixes = targets.groupBy("mix_id").agg(F.max("slots").alias("slots"), F.sort_array(F.collect_list(F.struct("lo", "source"))).alias("bounds")).where("slots > 0")
    total = mixes.agg(F.sum(F.ceil(F.col("slots") / SLOTS_PER_CHUNK))).first()[0] or 0
    chunks = mixes.select("mix_id", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOTS_PER_CHUNK})")).alias("chunk"), "slots", "bounds")
    # as many tasks as chunks, dealt in turn: adaptive execution would unite these few bytes into one task
    spread = chunks.repartition(int(min(max(total, 1), MOST_TASKS)))
    return spread.mapInArrow(_slots, f"mix_id {dict(targets.dtypes)['mix_id']}, source string, slot long, rank long")


def _targets(sizes: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    clean = targets.where("mix_id IS NOT NULL AND source IS NOT NULL AND weight > 0 AND max_repeat > 0 AND NOT isnan(weight)")
    clean = clean.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeat").alias("max_repeat"))
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("total")).where("total > 0")
    known = clean.join(there, "source")
    mix = W.partitionBy("mix_id")
    share = known.withColumn("share", F.col("weight") / F.sum("weight").over(mix))
    # the largest mixture in which every source reaches its share within its repeats
    slots = F.floor(F.min(F.col("total") * F.col("max_repeat") / F.col("share")).over(mix) / block).cast("long")
    upto = F.sum("share").over(mix.orderBy("source").rowsBetween(W.unboundedPreceding, -1))
    last = F.row_number().over(mix.orderBy(F.desc("source"))) == 1
    sized = share.select("mix_id", "source", "share", "max_repeat", "total", F.greatest(slots, F.lit(1)).alias("slots"), F.coalesce(upto, F.lit(0.0)).alias("lo"), last.alias("last"))
    return sized.withColumn("hi", F.when(F.col("last"), F.lit(1.0)).otherwise(F.lead("lo").over(mix.orderBy("source")))).drop("last")


def mix(sizes: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """(mix_id, slot, start, source, doc_id, repetition, n_tokens): the documents drawn for each mixture.

    ``sizes`` has doc_id, source and n_tokens, ``targets`` mix_id, source,
    weight and max_repeat.  Weights are relative to those of the mixture's
    sources that have tokens; a source without any gets none.  The size of a
    mixture is the largest at which each source reaches its share without
    repeating more than max_repeat times.  Order within a mixture is by slot,
    then start.  Documents without tokens, doc_id or source are never drawn; a
    repeated doc_id counts once, with its first source and the least tokens
    there.  Targets with a null, or without a positive
    weight and cap, are ignored, repeated ones added up.  Empty tables give an
    empty mixture.
    """
    clean = sizes.where("doc_id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d"))
    docs = materialise(clean.select("doc_id", "d.source", "d.n_tokens"))
    goals = materialise(_targets(docs, targets, block))
    # repetitions that any mixture can need of a source
    need = F.least(F.col("max_repeat").cast("long"), F.ceil((F.col("share") * F.col("slots") + 64) * block / F.col("total")))
    repeats = goals.groupBy("source").agg(F.max(need).cast("int").alias("repeats"))
    placed = streams(docs, repeats).withColumn("block", F.expr(f"start div {block}"))
    slots = schedule(goals)
    # every block of a source serves one slot of a mixture; a document may not start in the repetitions beyond the cap
    caps = goals.select(F.col("mix_id").alias("m_"), F.col("source").alias("s_"), "max_repeat")
    asked = slots.join(caps, (F.col("mix_id") == F.col("m_")) & (F.col("source") == F.col("s_"))).select("mix_id", "source", "slot", F.col("rank").alias("block"), "max_repeat")
    drawn = placed.join(asked.hint("merge"), ["source", "block"]).where("repetition < max_repeat")
    return drawn.select("mix_id", "slot", "start", "source", "doc_id", "repetition", "n_tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, wanted, reached, n_tokens, documents, repeats) for every target, reached or not."""
    got = drawn.groupBy("mix_id", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    got = got.groupBy("mix_id", "source").agg(F.sum("t").alias("n_tokens"), F.count(F.lit(1)).alias("documents"), F.max("k").alias("repeats"))
    goal = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"))
    both = goal.join(got, ["mix_id", "source"], "left").fillna(0, ["n_tokens", "documents", "repeats"])
    of = W.partitionBy("mix_id")
    return both.select("mix_id", "source", F.try_divide("weight", F.sum("weight").over(of)).alias("wanted"), F.try_divide("n_tokens", F.sum("n_tokens").over(of)).alias("reached"), "n_tokens", "documents", "repeats")
