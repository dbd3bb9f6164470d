"""Recordings of raw float32 files, one per channel behind a short header, and gated importers of other formats."""

from __future__ import annotations

import importlib.util
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError
from trialloom.model import Trials
from trialloom.plans.tables import running_total
from trialloom.sources import foreign

HEADER = 40  # bytes


def natural_key(name: str) -> list:
    """Order by the numbers in a name."""
    return [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", name)]


def raw_channels(spark: SparkSession, path: str, pattern: str = "*.sev", subtract_median: bool = False, piece: int = 1 << 20) -> tuple[DataFrame, list[str]]:
    """(channel_id, sample, value) of every file, and the files' names in natural order.

    Files are read by Spark; each is one task (a channel's file holds one
    recording).  With ``subtract_median`` the channel's median is taken off.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    names = sorted((r[0].rsplit("/", 1)[-1] for r in files.select("path").collect()), key=natural_key)
    if not names:
        raise DataError(f"no {pattern} in {path}")
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.element_at(F.split("path", "/"), -1)) - 1

    def run(batches):
        for pdf in batches:
            for ch, content in zip(pdf["channel_id"], pdf["content"]):
                x = np.frombuffer(content, "<f4", offset=min(HEADER, len(content)), count=max(0, (len(content) - HEADER) // 4)).astype(float)
                if subtract_median and len(x):
                    x = x - np.median(x)
                for a in range(0, len(x), piece):
                    part = x[a : a + piece]
                    yield pd.DataFrame({"channel_id": np.int32(ch), "sample": np.arange(a, a + len(part), dtype=np.int64), "value": part})

    long = files.select(at.cast("int").alias("channel_id"), "content").mapInPandas(run, "channel_id int, sample long, value double")
    return long, names


def paired_trials(marks: DataFrame, start_code: int, end_code: int, samplerate: float, keys: list[str] | None = None) -> DataFrame:
    """Trials of marks (time in s, code): the i-th start with the i-th end, as far as both lists go, within ``keys`` if given.

    Marks are numbered by time in chunks, so a recording of any length is many tasks.
    """
    keys = keys or []
    timed = marks.where(F.col("code").isin([start_code, end_code]) & F.col("time").isNotNull() & ~F.isnan("time")).select(*keys, "code", "time", F.round(F.col("time") * 1e6).cast("long").alias("us"))
    n = running_total(timed, "us", F.lit(1), "i", 600_000_000, [*keys, "code"])
    a = n.where(F.col("code") == start_code).select(*keys, "i", F.round(F.col("time") * samplerate).cast("long").alias("start"))
    b = n.where(F.col("code") == end_code).select(*keys, "i", F.round(F.col("time") * samplerate).cast("long").alias("stop"))
    return a.join(b, [*keys, "i"]).select(*keys, F.col("i").cast("int").alias("trial_id"), "start", "stop", F.lit(0.0).alias("t0"), F.array(F.lit(float(start_code))).alias("info"))


def load_raw(spark: SparkSession, path: str, samplerate: float, marks: DataFrame | None = None, start_code: int | None = None, end_code: int | None = None, subtract_median: bool = False, pattern: str = "*.sev") -> Trials:
    """A folder of raw channel files as analog data, cut into trials between start and end marks if there are any."""
    from trialloom.operators.trials import cut_recording

    long, names = raw_channels(spark, path, pattern, subtract_median)
    labels = {"channel": [n.rsplit(".", 1)[0] for n in names]}
    if marks is None:
        whole = long.agg((F.max("sample") + 1).alias("stop")).select(F.lit(0).alias("trial_id"), F.lit(0).cast("long").alias("start"), F.col("stop").cast("long"), F.lit(0.0).alias("t0"), F.array().cast("array<double>").alias("info"))
        facts = long.select(F.lit(0).alias("trial_id"), F.col("sample").cast("int"), "channel_id", "value")
        return Trials("analog", facts, whole, samplerate, labels)
    trials = paired_trials(marks, start_code, end_code, samplerate)
    facts = cut_recording(long, trials.select("trial_id", "start", "stop"), []).select("trial_id", "sample", "channel_id", "value")
    return Trials("analog", facts, trials, samplerate, labels)


READERS: dict = {}


def register_reader(name: str, reader) -> None:
    """Add a reader ``(spark, path, **options)`` of one or several objects for a further format."""
    READERS[name] = reader


def load_foreign(spark: SparkSession, name: str, path: str, **options):
    """A file of a registered format; formats whose libraries are missing are not registered."""
    if name not in READERS:
        raise DataError(f"no reader for {name!r}; register_reader adds one (known: {', '.join(sorted(READERS)) or 'none'})")
    return READERS[name](spark, path, **options)


for _name, _module, _reader in (("nwb", "pynwb", foreign.load_nwb), ("mat", "scipy", foreign.load_mat), ("mat", "h5py", foreign.load_mat)):
    if importlib.util.find_spec(_module):
        register_reader(_name, _reader)


# --- the index of a recording block ----------------------------------------------------------------------------------

# Fixed values of the format: records of 40 bytes, codes of the block's start and stop, kinds of stores.
INDEX = np.dtype([("size", "<i4"), ("kind", "<u4"), ("code", "<u4"), ("channel", "<u2"), ("sort", "<u2"), ("time", "<f8"), ("value", "<f8"), ("format", "<u4"), ("rate", "<f4")])
START_BLOCK, STOP_BLOCK = 1, 2
STROBE_ON, STROBE_OFF, SCALAR, STREAM, SNIP, MARK = 0x101, 0x102, 0x201, 0x8101, 0x8201, 0x8801
KIND_MASK = 0xFF0F
INDEX_COLUMNS = "code long, name string, store string, channel int, sort int, time double, value double, size int, format int, rate double"


def _store_of(kind: np.ndarray) -> np.ndarray:
    return np.select(
        [np.isin(kind, (STROBE_ON, STROBE_OFF, MARK)), kind == SNIP, (kind & KIND_MASK) == STREAM, kind == SCALAR],
        [np.where(kind == STROBE_OFF, "offsets", "epocs"), "snips", "streams", "scalars"], "unknown",
    )


def block_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of a block's index file (one ``*.tsq`` in ``path``): code, name, kind of store, channel, time and value.

    The file is read in splits of whole records, so it may be of any size.
    value is the strobe's code of an epoc, and the offset of other records'
    data.  Records without a code are left out; the block's start and stop
    are records with the codes 1 and 2.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tsq").load(path).select("path").limit(2).collect()
    if len(found) != 1:
        raise DataError(f"{path} holds {'no' if not found else 'more than one'} *.tsq")
    records = spark.createDataFrame(spark.sparkContext.binaryRecords(found[0][0], INDEX.itemsize).map(lambda b: (bytearray(b),)), "record binary")

    def run(batches):
        for pdf in batches:
            x = np.frombuffer(b"".join(map(bytes, pdf["record"])), INDEX)
            x = x[x["code"] > 0]
            names = [c.tobytes().decode("cp437").rstrip("\0") for c in x["code"].astype("<u4").reshape(-1, 1)]
            value = np.where(_store_of(x["kind"]) == "epocs", x["value"], x["value"].view("<i8"))
            yield pd.DataFrame({"code": x["code"].astype("int64"), "name": names, "store": _store_of(x["kind"]).astype(str), "channel": x["channel"].astype("int32"), "sort": x["sort"].astype("int32"), "time": x["time"], "value": value.astype(float), "size": x["size"], "format": x["format"].astype("int32"), "rate": x["rate"].astype(float)})

    return records.mapInPandas(run, INDEX_COLUMNS)


def block_info(index: DataFrame) -> dict:
    """Start and stop of a block (seconds since 1970, stop null if it did not end cleanly), its duration, and its stores."""
    ends = {r["code"]: r["t"] for r in index.where(F.col("code").isin(START_BLOCK, STOP_BLOCK)).groupBy("code").agg(F.max("time").alias("t")).collect()}
    if START_BLOCK not in ends:
        raise DataError("the index has no start of the block")
    stores = index.where("store <> 'unknown' AND store <> 'offsets'").groupBy("name", "store").agg(F.max("rate").alias("rate"), F.countDistinct("channel").alias("channels"), F.count(F.lit(1)).alias("records"), F.min("time").alias("first"), F.max("time").alias("last"))
    start, stop = ends[START_BLOCK], ends.get(STOP_BLOCK)
    return {
        "start_time": start, "stop_time": stop, "duration": None if stop is None else stop - start,
        "stores": {r["name"]: {"type": r["store"], "rate": r["rate"], "channels": r["channels"], "records": r["records"]} for r in stores.orderBy("name").limit(10_000).collect()},
    }


def epocs(index: DataFrame, name: str, start: float) -> DataFrame:
    """(time, code) of an epoc store's onsets, in seconds since the block's start."""
    return index.where((F.col("name") == name) & (F.col("store") == "epocs")).select((F.col("time") - start).alias("time"), F.col("value").cast("int").alias("code"))


def load_block(spark: SparkSession, path: str, start_code: int | None = None, end_code: int | None = None, subtract_median: bool = False, stream: str | None = None, marks: str = "Mark", onsets: str = "PDio") -> Trials:
    """A recording block: its channel files as analog data at the rate that the index states, cut by its marks, if codes are given.

    Triggers (``marks``) and photodiode onsets (``onsets``) are registered as
    tables ``triggers`` and ``onsets`` with times, samples and codes; info holds
    what the index says about the block.
    """
    index = block_index(spark, path)
    info = block_info(index)
    streams = {n: s for n, s in info["stores"].items() if s["type"] == "streams"}
    if stream is None and len(streams) != 1:
        raise ParameterError(f"name one stream of {', '.join(sorted(streams)) or 'none'}")
    rate = streams[stream or next(iter(streams))]["rate"]
    triggers = epocs(index, marks, info["start_time"])
    out = load_raw(spark, path, rate, triggers if start_code is not None else None, start_code, end_code, subtract_median)
    at = F.round(F.col("time") * rate).cast("long").alias("sample")
    return out.having("read from a block", info=info).register("triggers", triggers.select("time", at, "code")).register("onsets", epocs(index, onsets, info["start_time"]).select("time", at, "code"))
