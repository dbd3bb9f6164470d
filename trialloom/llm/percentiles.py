"""Exact percentiles per group over very large columns, by distributed multi-select.

Values are packed once into sorted blocks.  In each round every block tells,
for every target still open, how many of its values lie below and at the
pivots, and proposes quantiles of its own part of the open range; proposals of
a partition are merged there.  The weighted quantiles of all proposals on
either side of the target become the next pivots, ruled-out ranges are
discarded, and rounds go on until the pivot with the target's rank is found.
(Two pivots from local quantiles in place of one from local medians rule out
more in a round.  Where they miss the target, the next round's pivot is the
weighted median of the proposals, which rules out two fifths at least, so the
number of rounds is bounded by the logarithm of the count.)  Groups of several
scopes, such as days and all days, are searched in the same rounds.

``summaries`` keeps a bounded number of weighted values per group and block,
with a bound of the rank error that is computed, not assumed; those of
partitions, days or tables are merged into summaries as bounded, whose bounds
add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.plans.tables import materialise

BLOCK = 65_536  # samples of a source that go to one task
PROPOSALS = 16  # local quantiles that a block, or a partition, proposes for an open range
FAN = 128  # sets of proposals that are merged at once
MERGED = 128  # quantiles kept of merged proposals within a task: an error of 1/256 a level
BROADCAST_BYTES = 32 << 20  # states up to this size are broadcast; larger ones are joined
MOST_AT_ONCE = 512  # blocks that are searched together
MARGIN = 0.03  # of the range, on either side of the target, between the pivots


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings to pieces (recording, channel, block) with samples and values, compressed."""
    from trialloom.operators.spikes import pack_readings

    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rec, ch, smp = (t.column(i).to_numpy().astype(np.int64) for i in range(3))
        val = t.column(3).to_numpy()
        block = smp // BLOCK
        same = (rec[1:] == rec[:-1]) & (ch[1:] == ch[:-1]) & (block[1:] == block[:-1])
        if (~same).sum() > len(rec) // 50:
            o = np.lexsort((smp, block, ch, rec))
            rec, ch, smp, val, block = rec[o], ch[o], smp[o], val[o], block[o]
            same = (rec[1:] == rec[:-1]) & (ch[1:] == ch[:-1]) & (block[1:] == block[:-1])
        cuts = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(rec)]))
        blobs = [pack_readings(smp[a:b], val[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        at = cuts[:-1]
        return pa.RecordBatch.from_arrays([pa.array(rec[at].astype(np.int32)), pa.array(ch[at].astype(np.int32)), pa.array(block[at]), pa.array(blobs, pa.binary())], ["recording_id", "channel_id", "block", "blob"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 250_000:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, ordered by day, channel and source, to one sorted block per day and channel of the partition (or several large ones)."""
    from trialloom.operators.spikes import once, unpack_readings

    group: tuple | None = None
    source: tuple | None = None
    smp: list[np.ndarray] = []
    val: list[np.ndarray] = []
    done: list[np.ndarray] = []
    out: list[tuple] = []

    def end_source() -> None:
        if smp:
            done.append(once(np.concatenate(smp), np.concatenate(val))[1])
            smp.clear()
            val.clear()

    def end_group() -> None:
        if done:
            v = np.sort(np.concatenate(done))
            if len(v):
                out.append((*group, len(v), v.astype("<f8").tobytes()))
            done.clear()

    def emit() -> pa.RecordBatch:
        day, ch, n, blob = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(day, pa.int32()), pa.array(ch, pa.int32()), pa.array(n, pa.int64()), pa.array(blob, pa.binary())], ["day", "channel_id", "n", "vals"])

    for batch in batches:
        for day, ch, rec, block, blob in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if source != (day, ch, rec, block):
                end_source()
                source = (day, ch, rec, block)
            if group != (day, ch) or sum(map(len, done)) > 500_000:
                end_group()
                group = (day, ch)
                if len(out) >= 500:
                    yield emit()
            s, v = unpack_readings(blob)
            smp.append(s)
            val.append(v)
    end_source()
    end_group()
    if out:
        yield emit()


def value_blocks(analog: DataFrame, recording: DataFrame) -> DataFrame:
    """(day, channel_id, n, vals) sorted blocks of all readings, repeated deliveries counted once.

    Nulls and NaN are missing and left out, infinities are values; of readings
    of one key the largest counts.  day is in
    days since 1970; it is null for recordings without a start.  Recordings,
    and stretches of a long one, are dealt to all tasks, so a group that holds a
    third of all rows has a block in each.
    """
    rows = analog.where("recording_id IS NOT NULL AND channel_id IS NOT NULL AND sample IS NOT NULL AND value IS NOT NULL")
    rows = rows.select(F.col("recording_id").cast("int"), F.col("channel_id").cast("int"), F.col("sample").cast("long"), F.col("value").cast("double"))
    pieces = rows.mapInArrow(_flatten, "recording_id int, channel_id int, block long, blob binary")
    days = recording.where("recording_id IS NOT NULL").groupBy(F.col("recording_id").cast("int").alias("r_")).agg(F.max(F.unix_date(F.to_date("utc_start_time"))).cast("int").alias("day"))
    dated = pieces.join(days, F.col("recording_id") == F.col("r_"), "left")
    placed = dated.repartition("recording_id", "block").sortWithinPartitions("day", "channel_id", "recording_id", "block")
    return placed.select("day", "channel_id", "recording_id", "block", "blob").mapInArrow(_sorted_blocks, "day int, channel_id int, n long, vals binary")


STATE = "k array<long>, lo array<double>, hi array<double>, p1 array<double>, p2 array<double>, value array<double>, open boolean"
# lo < the target < hi, both exclusive; NaN: no limit.  p1 <= p2 are the pivots, NaN before the first proposals.
FIELDS = ("k", "lo", "hi", "p1", "p2", "value")


def _places(v: np.ndarray, first: np.ndarray, last: np.ndarray, x: np.ndarray, right: bool) -> np.ndarray:
    """Where each ``x`` belongs in its own ordered stretch v[first:last], all searched at once."""
    lo, hi = first.copy(), last.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        at = v[np.minimum(mid, len(v) - 1)]
        up = (lo < hi) & ((at <= x) if right else (at < x))
        lo, hi = np.where(up, mid + 1, lo), np.where(up, hi, mid)
    return lo


def _count(v: np.ndarray, first: np.ndarray, last: np.ndarray, lo, hi, p1, p2):
    """Of ordered stretches: where the open range and the pivots lie, by stretch and target."""
    a = np.where(np.isnan(lo), first, _places(v, first, last, lo, True))
    b = np.where(np.isnan(hi), last, _places(v, first, last, hi, False))
    cuts = [np.clip(_places(v, first, last, p, right), a, b) for p, right in ((p1, False), (p1, True), (p2, False), (p2, True))]
    none = np.isnan(p1)
    l1, e1, l2, e2 = (np.where(none, x, c) for x, c in zip((a, a, b, b), cuts))
    return a, b, l1, e1, l2, e2


def _quantiles(props: list[tuple[np.ndarray, np.ndarray]], points: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals (values and weights, 3 x targets x n each) as ``points`` quantiles of equal weight."""
    v, w = (np.concatenate(x, axis=2) for x in zip(*props))
    if v.shape[2] == points and len(props) == 1:
        return v, w
    o = np.argsort(v, axis=2, kind="stable")
    v, w = np.take_along_axis(v, o, 2), np.take_along_axis(w, o, 2)
    upto = np.cumsum(w, axis=2)
    total = upto[..., -1:]
    wanted = (np.arange(points) + 0.5) / points * total
    if points * v.size < 1 << 20:
        at = (upto[..., None, :] < wanted[..., None]).sum(axis=-1)
    else:
        at = np.stack([[np.searchsorted(u, x) for u, x in zip(us, xs)] for us, xs in zip(upto, wanted)])
    return np.take_along_axis(v, np.minimum(at, v.shape[2] - 1), 2), np.repeat(total / points, points, axis=2)


class Ladder:
    """Proposals in any number: ``FAN`` of a level are merged into one of the next, so that errors grow with the number of levels only."""

    def __init__(self):
        self.levels: list[list] = [[]]

    def add(self, prop: tuple[np.ndarray, np.ndarray], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(prop)
        if len(self.levels[level]) >= FAN:
            full, self.levels[level] = self.levels[level], []
            self.add(_quantiles(full, MERGED), level + 1)

    def all(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [p for level in self.levels for p in level]


GRID = (np.arange(PROPOSALS) + 0.5) / PROPOSALS


def _sizes(counts: np.ndarray) -> np.ndarray:
    """Values left of the pivots, between and right of them (3 x targets)."""
    n, l1, e1, l2, e2 = counts
    return np.maximum(np.stack([l1, l2 - e1, n - e2]), 0)


def _report(scopes: list[list[int]], keys: int):
    """Blocks with the states of their groups to reports: counts, and proposals of the three ranges between the pivots.

    ``scopes`` gives the positions of each scope's keys; a block belongs to one group of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def emit() -> pa.RecordBatch:
            rows = [(*key, counts.astype("<i8").tobytes(), _quantiles(props.all(), PROPOSALS)[0].astype("<f8").tobytes()) for key, (counts, props) in held.items()]
            held.clear()
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[: keys + 1]], *[pa.array(c, pa.binary()) for c in cols[keys + 1 :]]], ["scope", *[f"k{i}" for i in range(keys)], "counts", "props"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(keys)]
            vals = batch.column(keys)
            wide = 8 if pa.types.is_large_binary(vals.type) else 4
            offset = np.frombuffer(vals.buffers()[1], f"<i{wide}", len(vals) + 1, wide * vals.offset).astype(np.int64) // 8
            v = np.frombuffer(vals.buffers()[2], "<f8", offset[-1])
            for scope, used in enumerate(scopes):
                states = batch.column(keys + 1 + scope)
                there = np.flatnonzero(states.is_valid().to_numpy(zero_copy_only=False))
                for i in (there[x : x + MOST_AT_ONCE] for x in range(0, len(there), MOST_AT_ONCE)):
                    state = states.take(pa.array(i))
                    limits = [pc.list_flatten(state.field(f)).to_numpy().reshape(len(i), -1) for f in ("lo", "hi", "p1", "p2")]
                    first, last = (np.broadcast_to(x[:, None], limits[0].shape) for x in (offset[i], offset[i + 1]))
                    a, b, l1, e1, l2, e2 = _count(v, first, last, *limits)
                    counts = np.stack([b - a, l1 - a, e1 - a, l2 - a, e2 - a])
                    size = _sizes(counts)
                    at = np.stack([a, e1, e2])[..., None] + np.floor(GRID * size[..., None]).astype(np.int64)  # left, middle, right: blocks x targets x 3
                    prop, weight = v[np.minimum(at, last[..., None] - 1)], np.broadcast_to(size[..., None] / PROPOSALS, at.shape)
                    own = [cols[j][i].tolist() if j in used else [NONE] * len(i) for j in range(keys)]
                    for k, key in enumerate(zip([scope] * len(i), *own)):
                        if key not in held:
                            held[key] = [np.zeros(counts.shape[::2], np.int64), Ladder()]
                        held[key][0] += counts[:, k]
                        held[key][1].add((prop[:, k], weight[:, k]))
            if len(held) > 5_000:
                yield emit()
        if held:
            yield emit()

    return run


NONE = -(2**31)  # a null key, or one that is not of the scope


def _decide(keys: int):
    """Reports and the state of a group, the state first, to its next state."""

    def step(state: dict, counts: np.ndarray, props: list) -> dict:
        k, lo, hi, p1, p2, value = (state[f] for f in FIELDS)
        n, l1, e1, l2, e2 = counts
        v, w = (np.concatenate(x, axis=2) for x in zip(*props))
        for t in range(len(k)):
            if k[t] < 0:
                continue
            missed = False
            if np.isnan(p1[t]):
                side = 1
            elif l1[t] <= k[t] < e1[t]:
                value[t], k[t] = p1[t], -1
                continue
            elif l2[t] <= k[t] < e2[t]:
                value[t], k[t] = p2[t], -1
                continue
            else:
                side = 0 if k[t] < l1[t] else 1 if k[t] < l2[t] else 2
                missed = side != 1 and p1[t] < p2[t]
                if side == 0:
                    hi[t] = p1[t]
                elif side == 1:
                    lo[t], hi[t], k[t] = p1[t], p2[t], k[t] - e1[t]
                else:
                    lo[t], k[t] = p2[t], k[t] - e2[t]
            left = _sizes(counts)[side, t]
            there = np.flatnonzero(w[side, t] > 0)  # without values in the range, a block proposes one from outside
            o = there[np.argsort(v[side, t][there], kind="stable")]
            x, upto = v[side, t][o], np.cumsum(w[side, t][o])
            share = (k[t] + 0.5) / max(left, 1)
            wanted = (0.5, 0.5) if missed else (share - MARGIN, share + MARGIN)
            p1[t], p2[t] = (x[min(int(np.searchsorted(upto, np.clip(s, 0, 1) * upto[-1])), len(x) - 1)] for s in wanted)
        return state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, counts, props = None, None, None, Ladder()
        out: list[tuple] = []

        def close() -> None:
            if state is not None and counts is not None:
                s = step(state, counts, props.all())
                out.append((*key, *[s[f].tolist() for f in FIELDS], bool((s["k"] >= 0).any())))

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            types = [*[pa.int32()] * (keys + 1), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 5, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["scope", *[f"k{i}" for i in range(keys)], *FIELDS, "open"])

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                at = (r["scope"], *(r[f"k{i}"] for i in range(keys)))
                if at != key:
                    close()
                    key, counts, props = at, None, Ladder()
                    state = None
                if r["counts"] is None:
                    state = {f: np.array(r[f], np.int64 if f == "k" else float) for f in FIELDS}
                    continue
                c = np.frombuffer(r["counts"], "<i8").reshape(5, -1)
                p = np.frombuffer(r["props"], "<f8").reshape(3, c.shape[1], PROPOSALS)
                counts = c.copy() if counts is None else counts + c
                props.add((p, np.repeat(_sizes(c)[..., None] / PROPOSALS, PROPOSALS, axis=2)))
            if len(out) > 2_000:
                yield emit()
        close()
        if out:
            yield emit()

    return run


def multi_select(blocks: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, q, value): the value of rank floor(q * (n - 1)) (0-based) of each group, exactly.

    ``blocks`` has the integer ``keys``, n and vals (sorted doubles).  A null key is
    a group like others; groups without values do not appear.
    """
    return multi_select_scopes(blocks, [keys], shares).select(*keys, "n", "q", "value")


def multi_select_scopes(blocks: DataFrame, scopes: list[list[str]], shares: list[float]) -> DataFrame:
    """(scope, keys, n, q, value): ``multi_select`` of several groupings in the same rounds.

    scope is the position in ``scopes``; keys that a scope does not have are null.
    """
    names = list(dict.fromkeys(c for keys in scopes for c in keys))
    k = [f"k{i}" for i in range(len(names))]
    of = [[names.index(c) for c in keys] for keys in scopes]
    named = blocks.select(*[F.coalesce(F.col(c), F.lit(NONE)).cast("int").alias(a) for c, a in zip(names, k)], "n", "vals")
    qs = sorted(set(shares))
    nan = F.array(*[F.lit(float("nan")) for _ in qs])
    ranks = F.array(*[F.floor(F.lit(q) * (F.col("n") - 1)).cast("long") for q in qs])
    # the finest groups are added up first, the others from them
    finest = materialise(named.groupBy(*k).agg(F.sum("n").alias("n")))
    group = ["scope", *k]
    each = [finest.select(F.lit(i).alias("scope"), *[F.col(c) if j in used else F.lit(NONE).alias(c) for j, c in enumerate(k)], "n") for i, used in enumerate(of)]
    sizes = materialise(reduce(DataFrame.unionByName, each).groupBy(*group).agg(F.sum("n").alias("n")))
    counted = sizes.agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("top")).first()
    few = counted["groups"] * (40 * len(qs) + 64) <= BROADCAST_BYTES
    state = sizes.select(*group, ranks.alias("k"), *[nan.alias(c) for c in FIELDS[1:]], F.lit(True).alias("open"))
    found: DataFrame | None = None
    key_types = ", ".join(f"{c} int" for c in group)
    for _ in range(2 * math.ceil(math.log((counted["top"] or 1) + 1, 1.5)) + 16):
        active = state.where("open")
        met = named
        for i, used in enumerate(of):
            side = active.where(F.col("scope") == i).select(*[F.col(k[j]).alias(f"s{i}_{j}") for j in used], F.struct("lo", "hi", "p1", "p2").alias(f"state{i}"))
            on = reduce(lambda a, b: a & b, [F.col(k[j]) == F.col(f"s{i}_{j}") for j in used])
            met = met.join(F.broadcast(side) if few else side, on, "left")
        states = [f"state{i}" for i in range(len(of))]
        met = met.where(F.coalesce(*states).isNotNull()).select(*k, "vals", *states)
        reports = met.mapInArrow(_report(of, len(k)), f"{key_types}, counts binary, props binary")
        both = active.drop("open").unionByName(reports, allowMissingColumns=True)
        ordered = both.repartition(*group).sortWithinPartitions(*group, F.col("counts").isNotNull())
        state = materialise(ordered.mapInArrow(_decide(len(k)), f"{key_types}, {STATE}"))
        closed = state.where("NOT open").select(*group, "value")
        found = closed if found is None else found.unionByName(closed)
        if state.where("open").isEmpty():
            break
    else:
        raise RuntimeError("multi-select did not end")
    each = found.select(*group, F.posexplode("value").alias("i", "value")).join(sizes, group)
    q = F.element_at(F.array(*[F.lit(x) for x in qs]), F.col("i") + 1)
    return each.select("scope", *[F.when(F.col(a) != NONE, F.col(a)).alias(c) for a, c in zip(k, names)], "n", q.alias("q"), "value")


# --- summaries that add up -------------------------------------------------------------------------------------------

POINTS = 64  # values of a block's summary
MERGED_POINTS = 1024  # of a merged one
SUMMARY = "n long, vals binary, weights binary, slack long"


def _squeeze_points(v: np.ndarray, w: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ordered weighted values in at most ``points`` parts, each as its middle value, and by how much that moves a rank at most.

    The rank of x is the weight of the values up to x.
    """
    new = np.append(True, v[1:] != v[:-1])
    at = np.flatnonzero(new)
    v, w = v[at], np.add.reduceat(w, at)
    if len(v) <= points:
        return v, w, 0
    upto = np.cumsum(w)
    part = ((upto - w / 2) * points / upto[-1]).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    last = np.append(first[1:], len(v)) - 1
    before = np.append(0, upto)[first]
    mid = np.searchsorted(upto, (before + upto[last] + 1) // 2)
    mid = np.clip(mid, first, last)
    moved = np.maximum(np.append(0, upto)[mid] - before, upto[last] - upto[mid])
    return v[mid], upto[last] - before, int(moved.max())


def _summarise(points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for blob in batch.column(batch.num_columns - 1):
                v = np.frombuffer(blob.as_buffer(), "<f8")
                x, w, slack = _squeeze_points(v, np.ones(len(v), np.int64), points)
                out.append((len(v), x.tobytes(), w.astype("<i8").tobytes(), slack))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.int64()))] if out else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], [*batch.schema.names[:-1], "n", "vals", "weights", "slack"])

    return run


def summaries(blocks: DataFrame, points: int = POINTS) -> DataFrame:
    """(day, channel_id, n, vals, weights, slack): each block's values as at most ``points`` weighted ones.

    A rank read off a summary is wrong by at most ``slack`` values.  Summaries
    may be united; ``merged`` makes few of many.
    """
    return blocks.select("day", "channel_id", "vals").mapInArrow(_summarise(points), f"day int, channel_id int, {SUMMARY}")


def _merge(keys: int, points: int):
    """Summaries to one for each key that a task meets, in whatever order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None

        def shrink(parts: list) -> list:
            n, v, w, slack = zip(*parts)
            v, w = np.concatenate(v), np.concatenate(w)
            o = np.argsort(v, kind="stable")
            v, w, more = _squeeze_points(v[o], w[o], points)
            return [(sum(n), v, w, sum(slack) + more)]

        def emit() -> pa.RecordBatch:
            rows = [(*key, n, v.tobytes(), w.astype("<i8").tobytes(), slack) for key, parts in held.items() for n, v, w, slack in shrink(parts)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, (n, v, w, slack) = row[:keys], row[keys:]
                parts = held.setdefault(key, [])
                parts.append((n, np.frombuffer(v, "<f8"), np.frombuffer(w, "<i8"), slack))
                if sum(len(p[1]) for p in parts) > 64 * points:
                    held[key] = shrink(parts)
            if len(held) > 5_000:
                yield emit()
        if held:
            yield emit()

    return run


def merged(parts: DataFrame, keys: list[str], points: int = MERGED_POINTS, salts: int = 16) -> DataFrame:
    """(keys, n, vals, weights, slack): one summary a group, of at most ``points`` values.

    Merged within the tasks that hold them, then by group and salt, then by
    group, so that no task meets more than one summary of each salt.  Each
    time at most a part in ``points`` is added to the error.
    """
    schema = ", ".join([*[f"{c} {t}" for c, t in parts.select(*keys).dtypes], SUMMARY])
    step = _merge(len(keys), points)
    columns = [*keys, "n", "vals", "weights", "slack"]
    local = parts.select(*columns).mapInArrow(step, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.repartition(*keys, "salt").select(*columns).mapInArrow(step, schema)
    return salted.repartition(*keys).mapInArrow(step, schema)


def combine(parts: DataFrame, keys: list[str], shares: list[float], points: int = MERGED_POINTS) -> DataFrame:
    """(keys, q, n, value, rank_error): quantiles of summaries added up, with the bound of the error as a share of n.

    value has a rank within n * rank_error of floor(q * (n - 1)).
    """
    qs = sorted(set(shares))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, (n, v, w, slack) = row[: len(keys)], row[len(keys) :]
                v, upto = np.frombuffer(v, "<f8"), np.cumsum(np.frombuffer(w, "<i8"))
                out += [(*key, q, n, float(v[np.searchsorted(upto, math.floor(q * (n - 1)), "right")]), slack / n) for q in qs if n]
            if out:
                types = [*[f.type for f in batch.schema][: len(keys)], pa.float64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*keys, "q", "n", "value", "rank_error"])

    schema = ", ".join([*[f"{c} {t}" for c, t in parts.select(*keys).dtypes], "q double, n long, value double, rank_error double"])
    return merged(parts, keys, points).mapInArrow(read, schema)


def counted_ranks(blocks: DataFrame, keys: list[str], quantiles: DataFrame) -> DataFrame:
    """``quantiles`` (keys, q, n, value, rank_error) with below and upto: how many values of the group are less, and at most as large.

    The quantiles of a group are one row of the join, a few for each share.
    """
    of = quantiles.groupBy(*[F.col(c).alias(f"{c}_") for c in keys]).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("asked"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys])
    met = blocks.join(of, on).select(*keys, "vals", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, vals, asked in zip(zip(*(c.to_pylist() for c in batch.columns[:-2])), batch.column(len(keys)), batch.column(len(keys) + 1).to_pylist()):
                v = np.frombuffer(vals.as_buffer(), "<f8")
                out += [(*key, x["q"], int(np.searchsorted(v, x["value"], "left")), int(np.searchsorted(v, x["value"], "right"))) for x in asked]
            if out:
                types = [*[f.type for f in batch.schema][: len(keys)], pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [*keys, "q", "below", "upto"])

    schema = ", ".join([*[f"{c} {t}" for c, t in blocks.select(*keys).dtypes], "q double, below long, upto long"])
    counts = met.mapInArrow(run, schema).groupBy(*keys, "q").agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"))
    a, b = quantiles.alias("a"), counts.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "q")])
    return a.join(b, same).select("a.*", "b.below", "b.upto")
