"""Readings that cannot be trusted: spikes, stuck stretches, impossible values.

Method: each source's readings are packed into blocks; every block measures
the distance of its readings from the local course (a running median), their
step-to-step change and the lengths of stretches that stay at one value.
These go into quantile sketches with logarithmic buckets, one per source and
hour, which merge by adding counts.  A reading is flagged if it lies outside
the expanded interquartile fences of its source in its hour (for a moderate
distance only if its rate of change is implausible, too), if it belongs to a
stretch of zero variance far longer than the source's stretches elsewhere, or
if the amplifier or quantity cannot deliver it.

The resolution of a source is the smallest step between values of any of its
blocks, so a block with few readings cannot raise it.  A stretch that leaves
what its block sees is put together from the first and last stretches of the
blocks it passes through, and counts and is judged by its whole length.

Only packed blocks, sketches and candidates are shuffled.  A source is split
into blocks of ``BLOCK`` samples, so a source with a third of all rows is many
tasks; its sketches are added up by hour first, then over its hours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialloom.plans.tables import materialise

try:
    import zstandard
except ImportError:  # the packing then costs more shuffle
    zstandard = None
    import zlib

BLOCK = 8192  # samples of a block
HALO = 512  # samples it sees beyond either border
HALF = 15  # half width of the running median, readings
GAMMA = 1.08  # ratio of neighbouring sketch buckets: 4 % error of a quantile
WIDTH = 3  # readings of a spike whose steps count for all of them
DISTINCT = 8  # values a block needs for its smallest step to count, if another block has as many
BROADCAST_BLOCKS = 400_000  # a row of 60 bytes for each of so many blocks is broadcast; of more, they are merged
UNIT = 1e-6  # lower border of the sketch's first bucket

RESIDUAL, CHANGE, RUN, STRETCH = 0, 1, 2, 3  # sketches
SPIKE, STUCK, STUCK_STEP, IMPOSSIBLE = 10, 11, 12, 13  # candidates
# by kind of stretch (0 to 2): a block's first and last stretch, if open or if closed in sight, and readings of open ones
PIECE, CLOSED, OPEN = 20, 30, 40

# Fixed values of the quantities that the amplifier does not limit, by label: lower and upper limit, both impossible themselves.
LIMITS = {"pupil_um": (0.0, 20000.0), "temp_c": (20.0, 46.0), "grip_n": (-1e-9, 5000.0)}


@dataclass(frozen=True)
class SpikeRule:
    """Fences as multiples of the interquartile range, lengths in readings."""

    far: float = 10.0  # beyond the quartile: flagged
    some: float = 6.4  # flagged if the rate of change is implausible, too
    rate: float = 4.0  # fence of the absolute step-to-step change, beyond its upper quartile
    floor: float = 0.8  # least interquartile range, in steps of the source's resolution
    inner: float = 1.5  # a reading within so many of its own block's ranges is never a spike
    least_hour: int = 256  # readings an hour needs to be its own context; else all hours of the source are
    least: int = 30  # readings below which a source has no normal behaviour
    stuck: int = 12  # a stretch up to this length is never stuck
    longer: float = 3.8  # a stuck stretch is so many times longer than the quantile ``usual`` of the source's stretches
    usual: float = 0.985


def _squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b) if zstandard else zlib.compress(b, 1)


def _expand(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b) if zstandard else zlib.decompress(b)


def pack_readings(sample: np.ndarray, value: np.ndarray) -> bytes:
    """First sample, differences to those before (below 2^31) and byte planes of values, compressed."""
    first = sample[:1].astype("<i8")
    steps = np.diff(sample, prepend=first).astype("<i4")
    planes = np.ascontiguousarray(value, "<f8").view(np.uint8).reshape(-1, 8).T
    return _squeeze(first.tobytes() + steps.tobytes() + planes.tobytes())


def unpack_readings(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _expand(blob)
    n = (len(raw) - 8) // 12
    sample = np.frombuffer(raw, "<i8", 1)[0] + np.cumsum(np.frombuffer(raw, "<i4", n, 8), dtype=np.int64)
    value = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 4 * n).reshape(8, n).T).view("<f8").ravel()
    return sample, value


def once(sample: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Readings that are not NaN in order of time; of several of one sample the largest, whatever order they came in."""
    there = ~np.isnan(value)
    sample, value = sample[there], value[there]
    if not (sample[1:] > sample[:-1]).all():
        o = np.lexsort((value, sample))
        sample, value = sample[o], value[o]
        last = np.append(sample[1:] != sample[:-1], True)
        sample, value = sample[last], value[last]
    return sample, value


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Readings to block pieces; a reading near a border goes to both blocks."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rec, ch, smp = (t.column(i).to_numpy() for i in range(3))
        val = t.column(3).to_numpy()
        if len(rec) > 1:
            r, c = rec.astype(np.int64), ch.astype(np.int64)
            inner = (r[1:] == r[:-1]) & (c[1:] == c[:-1])
            grows = (r[1:] > r[:-1]) | ((r[1:] == r[:-1]) & ((c[1:] > c[:-1]) | ((c[1:] == c[:-1]) & (smp[1:] > smp[:-1]))))
            if not grows.all():
                o = np.lexsort((smp, ch, rec))
                rec, ch, smp, val = rec[o], ch[o], smp[o], val[o]
                inner = (rec[1:] == rec[:-1]) & (ch[1:] == ch[:-1])
            cuts = np.concatenate(([0], np.flatnonzero(~inner) + 1, [len(rec)]))
        else:
            cuts = np.array([0, len(rec)])
        out: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = smp[a:b].astype(np.int64)
            lowest = int(s[0] - HALO) // BLOCK if s[0] >= BLOCK or s[0] < 0 else 0
            for k in range(lowest, int(s[-1] + HALO) // BLOCK + 1):
                i, j = np.searchsorted(s, (k * BLOCK - HALO, (k + 1) * BLOCK + HALO))
                if i < j:
                    out.append((int(rec[a]), int(ch[a]), k, pack_readings(s[i:j], val[a + i : a + j])))
        r, c, k, blob = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(k, pa.int64()), pa.array(blob, pa.binary())], ["recording_id", "channel_id", "block", "blob"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 250_000:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _bucket(x: np.ndarray) -> np.ndarray:
    """Signed logarithmic bucket; 0 holds what is below the unit."""
    m = np.ceil(np.log(np.maximum(np.abs(x) / UNIT, 1.0)) / np.log(GAMMA)).astype(np.int64)
    return np.where(x < 0, -m, m)


def _resolution(val: np.ndarray) -> tuple[float, int]:
    """Smallest difference of the values (0 without one), and how many values differ."""
    v = np.sort(val)
    d = np.diff(v)
    d = d[d > 1e-9 * max(abs(v[0]), abs(v[-1]))]
    return (float(d.min()), len(d) + 1) if len(d) else (0.0, 1)


def _impossible(val, lo, hi) -> np.ndarray:
    return ~((val > lo) & (val < hi)) | np.isinf(val)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces to blocks, with what the source's resolution is derived from; blocks without own readings are left out."""
    schema = pa.schema([
        ("recording_id", pa.int32()), ("channel_id", pa.int32()), ("block", pa.int64()), ("blobs", pa.list_(pa.binary())), ("lo", pa.float64()), ("hi", pa.float64()),
        ("start", pa.float64()), ("fs", pa.float64()), ("step", pa.float64()), ("fine", pa.float64()), ("anchor", pa.float64()),
    ])
    out: list[tuple] = []
    rows = 0

    def close(key: tuple, blobs: list[bytes], rest: tuple) -> None:
        nonlocal rows
        smp, val = once(*(np.concatenate(x) for x in zip(*map(unpack_readings, blobs))))
        own = (smp >= key[2] * BLOCK) & (smp < (key[2] + 1) * BLOCK)
        if not own.any():
            return
        smp, val = smp[own], val[own]
        good = ~_impossible(val, rest[0], rest[1])
        step = fine = anchor = None
        if good.any():
            step, n = _resolution(val[good])
            step = step or None
            fine = step if n >= DISTINCT else None
            anchor = float(val[good][0])
        out.append((*key, blobs, *rest, step, fine, anchor))
        rows += len(smp)

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    at, blobs, rest = None, [], ()
    for batch in batches:
        for rec, ch, block, blob, *more in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if (rec, ch, block) != at:
                if at is not None:
                    close(at, blobs, rest)
                if rows > 400_000:
                    yield flush()
                    out, rows = [], 0
                at, blobs, rest = (rec, ch, block), [], tuple(more)
            blobs.append(blob)
    if at is not None:
        close(at, blobs, rest)
    if out:
        yield flush()


def _runs(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run number of each reading and the runs' lengths; a run ends where the key changes or a block begins."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | first[1:]
    run = np.cumsum(new) - 1
    return run, np.bincount(run)


def _measure_blocks(g, rec, ch, block, lo, hi, start, fs, smp, val, rule, source=None):
    """Candidates and sketches of many blocks at once; arrays are per reading for g, smp, val and per block else.

    Readings are ordered by block and time, one for each sample.
    ``source`` is the step and a value of each block's source, and whether it
    has readings in lower and higher blocks; without it, a block is a source of
    its own.
    """
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]  # block index, hour, kind, bucket, count, measure

    def emit(gi, hour, kind, bucket, cnt, measure=None):
        n = len(gi)
        for c, x in zip(cols, (gi, hour, np.full(n, kind, np.int64), bucket, cnt, np.zeros(n) if measure is None else measure)):
            c.append(np.asarray(x))

    def emit_counts(gi, hour, kind, bucket):
        if len(gi):
            h0, b0 = hour.min(), bucket.min()
            hs, bs = int(hour.max() - h0) + 1, int(bucket.max() - b0) + 1
            key, cnt = np.unique((gi.astype(np.int64) * hs + (hour - h0)) * bs + (bucket - b0), return_counts=True)
            rest, bk = np.divmod(key, bs)
            gg, hh = np.divmod(rest, hs)
            emit(gg, hh + h0, kind, bk + b0, cnt)

    own = (smp >= block[g] * BLOCK) & (smp < (block[g] + 1) * BLOCK)
    hour = np.floor((start[g] + smp / fs[g]) / 3600.0).astype(np.int64)
    bad = _impossible(val, lo[g], hi[g])
    w = bad & own
    emit(g[w], hour[w], IMPOSSIBLE, smp[w], np.ones(w.sum(), np.int64))
    g, smp, val, own, hour = g[~bad], smp[~bad], val[~bad], own[~bad], hour[~bad]
    if not len(g):
        return cols
    first = np.ones(len(g), bool)
    first[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(g))
    size = ends - at
    seg = np.cumsum(first) - 1
    # the course: a running median, the ends mirrored
    padded_at = np.concatenate(([0], np.cumsum(size + 2 * HALF)))
    pos = np.arange(padded_at[-1]) - np.repeat(padded_at[:-1], size + 2 * HALF) - HALF
    length = np.repeat(size, size + 2 * HALF)
    period = np.maximum(2 * (length - 1), 1)
    pos %= period
    pos = np.where(pos >= length, period - pos, pos)
    padded = val[np.repeat(at, size + 2 * HALF) + pos]
    centre = np.arange(len(g)) + 2 * HALF * seg  # left end of its window in padded
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * HALF + 1)
    course = np.empty(len(g))
    for a in range(0, len(g), 60_000):
        course[a : a + 60_000] = np.partition(windows[centre[a : a + 60_000]], HALF, axis=1)[:, HALF]
    res = val - course
    # step of the source's resolution and spread of each block
    if source is None:
        step, anchor = np.array([_resolution(val[a:b])[0] for a, b in zip(at, ends)]), val[at]
        below = above = np.zeros(len(at), bool)
    else:
        step, anchor, below, above = (x[g[at]] for x in source)
    spread = np.zeros(len(at))
    for i, (a, b) in enumerate(zip(at, ends)):
        n = b - a
        q = np.partition(res[a:b], (n // 4, (3 * n) // 4))
        spread[i] = q[(3 * n) // 4] - q[n // 4]
    st = step[seg]
    base = rule.floor * step
    change = np.zeros(len(g))
    change[1:] = np.where(first[1:], 0.0, np.abs(val[1:] - val[:-1]))
    # the largest step near a reading: readings inside a spike share the steps at its ends
    most = change.copy()
    for k in range(1, WIDTH + 1):
        same = seg[k:] == seg[:-k]
        most[:-k] = np.maximum(most[:-k], np.where(same, change[k:], 0.0))
        if k < WIDTH:
            most[k:] = np.maximum(most[k:], np.where(same, change[:-k], 0.0))
    emit_counts(g[own], hour[own], RESIDUAL, _bucket(res[own]))
    w = own & ~first
    emit_counts(g[w], hour[w], CHANGE, _bucket(change[w]))
    far = np.maximum(rule.inner * np.maximum(spread, base), rule.some * base)[seg]
    w = own & (np.abs(res) > far)
    emit(g[w], hour[w], SPIKE, smp[w], _bucket(most[w]), res[w])
    # stretches at one value, and within one step: either parity of the lower level
    safe = np.where(st > 0, st, 1.0)
    level = np.rint((val - anchor[seg]) / safe).astype(np.int64)
    last = np.zeros(len(g), bool)
    last[ends - 1] = True
    edge = (first & below[seg]) | (last & above[seg])  # the stretch may go on out of sight
    mine = np.flatnonzero(own & (below | above)[seg])
    lead = mine[np.flatnonzero(np.diff(seg[mine], prepend=-1))]
    tail = mine[np.flatnonzero(np.diff(seg[mine], append=-1))]
    for i, (kind, stuck, key) in enumerate(((RUN, STUCK, level), (STRETCH, STUCK_STEP, level >> 1), (STRETCH, STUCK_STEP, (level - 1) >> 1))):
        run, count = _runs(key, first)
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        goes_on = np.zeros(len(count), bool)
        goes_on[run[edge]] = True
        w = own[starts] & ~goes_on
        emit_counts(g[starts][w], hour[starts][w], kind, count[w])
        n = count[run]
        w = own & (n > rule.stuck) & ~goes_on[run]
        emit(g[w], hour[w], stuck, smp[w], n[w])
        if not len(mine):
            continue
        # the place of a first stretch is twice its block, of a last one that plus 1
        within = np.bincount(run[own], minlength=len(count))
        two = run[lead] != run[tail]
        for o, place in ((lead, 0), (starts[run[tail[two]]], 1)):
            for border, w in ((PIECE, goes_on[run[o]]), (CLOSED, ~goes_on[run[o]])):
                x = o[w]
                emit(g[x], hour[x], border + i, block[g[x]].astype(np.int64) * 2 + place, within[run[x]], key[x])
        lead_run = np.full(len(at), -1)
        lead_run[seg[lead]] = run[lead]
        w = own & goes_on[run]
        emit(g[w], hour[w], OPEN + i, smp[w], block[g[w]].astype(np.int64) * 2 + (run[w] != lead_run[seg[w]]))
    # the least interquartile range that the step gives, as the sketch's floor
    emit(g[at], hour[at], RESIDUAL, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), base)
    return cols


# --- sketches: what a source's fences in an hour are read from -------------------------------------------------------

COUNT = np.dtype([("kind", "u1"), ("bucket", "<i8"), ("cnt", "<i8")])


def pack_sketch(kind, bucket, cnt, floor: float) -> bytes:
    """Counts by sketch and bucket, and the least interquartile range."""
    rows = np.empty(len(kind), COUNT)
    rows["kind"], rows["bucket"], rows["cnt"] = kind, bucket, cnt
    return _squeeze(np.float64(floor).tobytes() + np.ascontiguousarray(rows.view(np.uint8).reshape(-1, COUNT.itemsize).T).tobytes())


def unpack_sketch(blob: bytes) -> tuple[np.ndarray, float]:
    raw = _expand(blob)
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(COUNT.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(COUNT).ravel(), float(np.frombuffer(raw, "<f8", 1)[0])


def add_up(rows: np.ndarray) -> np.ndarray:
    """One row for each sketch and bucket, in order."""
    rows = rows[np.lexsort((rows["bucket"], rows["kind"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["kind"][1:] != rows["kind"][:-1]) | (rows["bucket"][1:] != rows["bucket"][:-1])
    at = np.flatnonzero(new)
    out = rows[at]
    out["cnt"] = np.add.reduceat(rows["cnt"], at) if len(at) else out["cnt"]
    return out


def _middle(bucket: int) -> float:
    """The value in the middle of a bucket."""
    return float(np.sign(bucket) * UNIT * GAMMA ** (abs(bucket) - 0.5)) if bucket else 0.0


def fences_of(rows: np.ndarray, floor: float, usual: float) -> dict:
    """n, quartiles of distances and changes, interquartile range and usual lengths of stretches of added-up counts."""

    def quantiles(kind, *shares):
        part = rows[np.searchsorted(rows["kind"], kind) : np.searchsorted(rows["kind"], kind, "right")]
        upto = np.cumsum(part["cnt"])
        if not len(upto) or not upto[-1]:
            return [None] * len(shares), 0
        return [int(part["bucket"][np.searchsorted(upto, x * upto[-1])]) for x in shares], int(upto[-1])

    (q1, q3), n = quantiles(RESIDUAL, 0.25, 0.75)
    (c1, c3), _ = quantiles(CHANGE, 0.25, 0.75)
    (run,), _ = quantiles(RUN, usual)
    (stretch,), _ = quantiles(STRETCH, usual)
    q1, q3, c1, c3 = (None if x is None else _middle(x) for x in (q1, q3, c1, c3))
    return dict(n=n, q1=q1, q3=q3, iqr=None if q1 is None else max(q3 - q1, floor), c1=c1, c3=c3, run=run, stretch=stretch)


def _merge_hours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches and single counts, ordered by source and hour, to one sketch for each."""
    at, held, floor, out = None, [], 0.0, []

    def close() -> None:
        rows = add_up(np.concatenate(held))
        out.append((*at, pack_sketch(rows["kind"], rows["bucket"], rows["cnt"], floor)))

    def emit() -> pa.RecordBatch:
        rec, ch, hour, blob = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(rec, pa.int32()), pa.array(ch, pa.int32()), pa.array(hour, pa.int64()), pa.array(blob, pa.binary())], ["recording_id", "channel_id", "hour", "sketch"])

    for batch in batches:
        for rec, ch, hour, blob, kind, bucket, cnt in zip(*(c.to_pylist() for c in batch.columns)):
            if (rec, ch, hour) != at:
                if at is not None:
                    close()
                at, held, floor = (rec, ch, hour), [], 0.0
            if blob is None:
                held.append(np.array([(kind, bucket, cnt)], COUNT))
            else:
                rows, least = unpack_sketch(blob)
                held.append(rows)
                floor = max(floor, least)
            if len(held) > 500:
                held = [add_up(np.concatenate(held))]
        if len(out) > 5_000:
            yield emit()
    if at is not None:
        close()
    if out:
        yield emit()


FENCES = "recording_id int, channel_id int, hour long, n long, q1 double, q3 double, iqr double, c1 double, c3 double, run long, stretch long"
FENCE_NAMES = [x.split()[0] for x in FENCES.split(", ")]


def _fences(rule: SpikeRule):
    """Sketches of hours, ordered by source, to the fences of each hour; those of few readings are the source's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, floor, hours, out = None, [], 0.0, [], []

        def close() -> None:
            whole = fences_of(add_up(np.concatenate(total)), floor, rule.usual)
            for hour, own in hours:
                use = own if own["n"] >= rule.least_hour else whole
                # the floor is the source's, in every hour
                iqr = None if use["iqr"] is None else max(use["iqr"], floor)
                out.append((*at, hour, whole["n"], use["q1"], use["q3"], iqr, use["c1"], use["c3"], whole["run"], whole["stretch"]))

        def emit() -> pa.RecordBatch:
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, FENCE_NAMES)

        for batch in batches:
            for rec, ch, hour, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (rec, ch) != at:
                    if at is not None:
                        close()
                    at, total, floor, hours = (rec, ch), [], 0.0, []
                rows, least = unpack_sketch(blob)
                hours.append((hour, fences_of(rows, least, rule.usual)))
                total.append(rows)
                floor = max(floor, least)
                if len(total) > 500:
                    total = [add_up(np.concatenate(total))]
            if len(out) > 20_000:
                yield emit()
        if at is not None:
            close()
        if out:
            yield emit()

    return run


def _measure(rule: SpikeRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta: list[tuple] = []
        smp: list[np.ndarray] = []
        val: list[np.ndarray] = []
        of: list[np.ndarray] = []
        rows = 0

        def flush():
            rec, ch, block, lo, hi, start, fs, *source = (np.array(x) for x in zip(*meta))
            cols = _measure_blocks(np.concatenate(of), rec, ch, block, lo, hi, start, fs, np.concatenate(smp), np.concatenate(val), rule, source)
            gi, hour, kind, bucket, cnt, measure = (np.concatenate(c) if c else np.zeros(0) for c in cols)
            gi, hour, kind, bucket, cnt, measure = gi.astype(np.int64), hour.astype(np.int64), kind.astype(np.int32), bucket.astype(np.int64), cnt.astype(np.int64), measure.astype(float)
            counted = kind <= STRETCH
            o = np.flatnonzero(counted)
            o = o[np.lexsort((hour[o], gi[o]))]
            cuts = np.flatnonzero(np.diff(gi[o], prepend=-1) | np.diff(hour[o], prepend=-1))
            blobs = [pack_sketch(kind[x], bucket[x], cnt[x], measure[x].max()) for x in np.split(o, cuts[1:])] if len(o) else []
            single, first = ~counted, o[cuts] if len(o) else o
            n = int(single.sum())

            def both(column, sketches, kind_of):
                return pa.array(np.concatenate([column[single], sketches]), kind_of)

            none = np.zeros(len(first), np.int64)
            return pa.RecordBatch.from_arrays(
                [both(rec[gi], rec[gi[first]], pa.int32()), both(ch[gi], ch[gi[first]], pa.int32()), both(hour, hour[first], pa.int64()), both(kind, none + RESIDUAL, pa.int32()), both(bucket, none, pa.int64()), both(cnt, none, pa.int64()), both(measure, none, pa.float64()), pa.array([None] * n + blobs, pa.binary())],
                ["recording_id", "channel_id", "hour", "kind", "bucket", "cnt", "measure", "sketch"],
            )

        for batch in batches:
            for rec, ch, block, blobs, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if rows > 400_000:
                    yield flush()
                    meta, smp, val, of, rows = [], [], [], [], 0
                meta.append((rec, ch, block, *rest))
                s, v = once(*(np.concatenate(x) for x in zip(*map(unpack_readings, blobs))))
                smp.append(s)
                val.append(v)
                of.append(np.full(len(s), len(meta) - 1))
                rows += len(s)
        if meta:
            yield flush()

    return run


def suspect_readings(analog: DataFrame, recording: DataFrame, label: DataFrame, rule: SpikeRule = SpikeRule(), limits: dict[str, tuple[float, float]] = LIMITS) -> DataFrame:
    """(recording_id, channel_id, sample, reason) of every reading not to be trusted.

    Nulls and NaN are missing: never flagged, and neither do they end a
    stretch.  Repeated deliveries count once.  A recording without a row in
    ``recording`` has no amplifier limit and one context, a channel whose label
    is not in ``limits`` only the amplifier's limit.  Of readings of one key
    the largest counts.  Rows with a null key or sample are
    ignored, extra columns too, and an empty table gives an empty result.
    """
    readings = analog.where("recording_id IS NOT NULL AND channel_id IS NOT NULL AND sample IS NOT NULL AND value IS NOT NULL").select(
        F.col("recording_id").cast("int"), F.col("channel_id").cast("int"), F.col("sample").cast("long"), F.col("value").cast("double")
    )
    pieces = readings.mapInArrow(_pack, "recording_id int, channel_id int, block long, blob binary")
    rec = recording.where("recording_id IS NOT NULL").groupBy(F.col("recording_id").cast("int").alias("rid")).agg(
        F.max("adc_range").cast("double").alias("adc"), F.max(F.unix_micros("utc_start_time") / 1e6).alias("start"), F.max("samplerate").cast("double").alias("fs")
    )
    quantity = label.where("axis = 'channel' AND idx IS NOT NULL").groupBy(F.col("idx").cast("int").alias("cid")).agg(F.max("label").alias("quantity"))
    lo, hi = F.coalesce(-F.col("adc"), F.lit(float("-inf"))), F.coalesce(F.col("adc"), F.lit(float("inf")))
    for name, (a, b) in limits.items():
        lo = F.when(F.col("quantity") == name, F.lit(a)).otherwise(lo)
        hi = F.when(F.col("quantity") == name, F.lit(b)).otherwise(hi)
    blocks = (
        pieces.join(rec, F.col("recording_id") == F.col("rid"), "left")
        .join(quantity, F.col("channel_id") == F.col("cid"), "left")
        .select("recording_id", "channel_id", "block", "blob", lo.alias("lo"), hi.alias("hi"), F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce(F.when(F.col("fs") > 0, F.col("fs")), F.lit(1e12)).alias("fs"))
        .repartition("recording_id", "channel_id", "block")
        .sortWithinPartitions("recording_id", "channel_id", "block")
        .mapInArrow(_whole, "recording_id int, channel_id int, block long, blobs array<binary>, lo double, hi double, start double, fs double, step double, fine double, anchor double")
        .persist()
    )
    # one step and one anchor of levels for all blocks of a source; only these small rows are shuffled by source
    key = ["recording_id", "channel_id", "block"]
    of = W.partitionBy("recording_id", "channel_id")
    filled = F.when(F.col("anchor").isNotNull(), F.col("block"))
    shared = materialise(blocks.select(
        *key, F.coalesce(F.min("fine").over(of), F.min("step").over(of), F.lit(0.0)).alias("s_step"),
        F.coalesce(F.min(F.when(F.col("anchor").isNotNull(), F.struct("block", "anchor"))).over(of)["anchor"], F.lit(0.0)).alias("s_anchor"),
        F.coalesce(F.min(filled).over(of) < F.col("block"), F.lit(False)).alias("below"), F.coalesce(F.max(filled).over(of) > F.col("block"), F.lit(False)).alias("above"),
    ))
    small = shared.count() <= BROADCAST_BLOCKS
    met = blocks.join(F.broadcast(shared) if small else shared.hint("merge"), key)
    whole = met.select(*key, "blobs", "lo", "hi", "start", "fs", "s_step", "s_anchor", "below", "above")
    measured = materialise(whole.mapInArrow(_measure(rule), "recording_id int, channel_id int, hour long, kind int, bucket long, cnt long, measure double, sketch binary"))
    blocks.unpersist()

    # stretches over blocks: pieces of one level follow one another, but for a block's first and last stretch
    source = ["recording_id", "channel_id"]
    key = (F.col("kind") % 10).alias("key")
    piece = measured.where(F.col("kind").between(PIECE, OPEN - 1)).select(*source, "hour", key, (F.col("kind") < CLOSED).alias("open"), F.col("bucket").alias("place"), "cnt", "measure")
    along = W.partitionBy(*source, "key").orderBy("place")
    new = (F.pmod("place", F.lit(2)) == 1) | F.coalesce(F.lag("measure").over(along) != F.col("measure"), F.lit(True))
    piece = piece.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(along))
    piece = piece.withColumn("length", F.sum("cnt").over(W.partitionBy(*source, "key", "run")))
    columns = [*source, "hour", "kind", "bucket", "cnt", "measure"]
    begun = piece.where("new AND open").select(*source, "hour", F.when(F.col("key") == 0, RUN).otherwise(STRETCH).alias("kind"), F.col("length").alias("bucket"), F.lit(1).cast("long").alias("cnt"), F.lit(0.0).alias("measure"))
    reading = measured.where(F.col("kind") >= OPEN).select(*source, "hour", key, "bucket", F.col("cnt").alias("place"))
    passing = reading.join(piece.select(*source, "key", "place", "length"), [*source, "key", "place"]).where(F.col("length") > rule.stuck)
    passing = passing.select(*source, "hour", F.when(F.col("key") == 0, STUCK).otherwise(STUCK_STEP).alias("kind"), "bucket", F.col("length").alias("cnt"), F.lit(0.0).alias("measure"))

    # merge the sketches: of each hour, then of all hours of a source
    sketches = measured.where("sketch IS NOT NULL").select(*source, "hour", "sketch", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("cnt"))
    counts = begun.groupBy(*source, "hour", "kind", "bucket").agg(F.sum("cnt").alias("cnt")).select(*source, "hour", F.lit(None).cast("binary").alias("sketch"), "kind", "bucket", "cnt")
    by_hour = sketches.unionByName(counts).repartition(*source, "hour").sortWithinPartitions(*source, "hour")
    hours = by_hour.mapInArrow(_merge_hours, "recording_id int, channel_id int, hour long, sketch binary")
    fences = hours.repartition(*source).sortWithinPartitions(*source, "hour").mapInArrow(_fences(rule), FENCES)
    fences = fences.select(*[F.col(c).alias(f"f_{c}") for c in FENCE_NAMES])

    found = measured.where(F.col("kind").between(SPIKE, IMPOSSIBLE)).select(*columns).unionByName(passing)
    joined = found.join(fences, (F.col("recording_id") == F.col("f_recording_id")) & (F.col("channel_id") == F.col("f_channel_id")) & (F.col("hour") == F.col("f_hour")), "left")

    def middle(b):  # the value in the middle of a bucket
        return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * UNIT * F.pow(F.lit(GAMMA), F.abs(b) - 0.5))

    f = {c: F.col(f"f_{c}") for c in ("q1", "q3", "iqr", "c1", "c3")}
    beyond = F.greatest(F.col("measure") - f["q3"], f["q1"] - F.col("measure"))
    jump = middle(F.col("cnt")) > f["c3"] + rule.rate * F.greatest(f["c3"] - f["c1"], f["iqr"])
    known = F.col("f_n") >= rule.least
    reason = (
        F.when(F.col("kind") == IMPOSSIBLE, F.lit("impossible"))
        .when((F.col("kind") == SPIKE) & known & ((beyond > rule.far * f["iqr"]) | ((beyond > rule.some * f["iqr"]) & jump)), F.lit("spike"))
        .when((F.col("kind") == STUCK) & known & (F.col("cnt") > rule.longer * F.col("f_run")), F.lit("stuck"))
        .when((F.col("kind") == STUCK_STEP) & known & (F.col("cnt") > rule.longer * F.col("f_stretch")), F.lit("stuck"))
    )
    return (
        joined.select("recording_id", "channel_id", F.col("bucket").alias("sample"), reason.alias("reason"))
        .where(F.col("reason").isNotNull())
        .groupBy("recording_id", "channel_id", "sample")
        .agg(F.min("reason").alias("reason"))
    )
