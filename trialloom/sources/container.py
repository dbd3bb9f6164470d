"""Objects saved as folders of parquet tables with a JSON sidecar."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid

from pyspark.sql import SparkSession

from trialloom.errors import DataError, ParameterError
from trialloom.model import Trials

SIDE = "object.json"
VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, path_of = _fs(spark, path)
    out = fs.create(path_of(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def checksum(data: Trials) -> str:
    """Order-independent digest of the facts: number of rows, and the sum of the rows' hashes."""
    from pyspark.sql import functions as F

    h = F.xxhash64(*sorted(data.facts.columns)).cast("decimal(38,0)")
    r = data.facts.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")).first()
    return hashlib.sha1(f"{r['n']}:{r['h']}".encode()).hexdigest()


def save(data: Trials, container: str, tag: str | None = None, overwrite: bool = False) -> str:
    """Write an object to ``container``/<tag>.<kind>; returns the folder.

    Facts of continuous data lie in one folder per trial bucket, so that a
    selection of trials prunes files.  Everything is written beside the folder
    and takes its place at the end, so an object may be saved over the files
    it is read from.
    """
    from pyspark.sql import functions as F

    spark = data.spark
    folder = f"{container.rstrip('/')}/{tag or 'data'}.{data.kind}"
    fs, path_of = _fs(spark, folder)
    if fs.exists(path_of(folder)) and not overwrite:
        raise DataError(f"{folder} exists; overwrite=True replaces it")
    beside = f"{folder}.{uuid.uuid4().hex}.part"
    writer = data.facts
    if "trial_id" in data.facts.columns:
        writer = data.facts.withColumn("trial_bucket", F.floor(F.col("trial_id") / 64)).write.partitionBy("trial_bucket")
    else:
        writer = writer.write
    writer.parquet(f"{beside}/facts")
    data.trials.write.parquet(f"{beside}/trials")
    for name, df in data.extras.items():
        df.write.parquet(f"{beside}/extras/{name}")
    written = data.having(facts=spark.read.schema(data.facts.schema).parquet(f"{beside}/facts").select(*data.facts.columns))
    cfg = {**data.cfg, "saved": {"container": container, "tag": tag or "data"}}
    side = {
        "version": VERSION, "kind": data.kind, "samplerate": data.samplerate, "labels": data.labels, "info": data.info, "cfg": cfg, "log": list(data.log),
        "extras": sorted(data.extras), "columns": data.facts.columns, "checksum": checksum(written),
    }
    _write_text(spark, f"{beside}/{SIDE}", json.dumps(side, indent=1, default=str))
    fs.delete(path_of(folder), True)
    if not fs.rename(path_of(beside), path_of(folder)):
        raise DataError(f"{folder} could not be written")
    return folder


def _load_one(spark: SparkSession, folder: str, check: bool) -> Trials:
    side = json.loads(_read_text(spark, f"{folder}/{SIDE}"))
    facts = spark.read.parquet(f"{folder}/facts").select(*side["columns"])
    out = Trials(
        side["kind"], facts, spark.read.parquet(f"{folder}/trials"), side["samplerate"], side["labels"], side["info"], side["cfg"], tuple(side["log"]),
        {n: spark.read.parquet(f"{folder}/extras/{n}") for n in side["extras"]},
    )
    if check and checksum(out) != side["checksum"]:
        raise DataError(f"{folder}: the data differs from its checksum")
    return out


def load(spark: SparkSession, path: str, tag: str | None = None, kind: str | list[str] | None = None, checksum: bool = False):
    """One object of its folder, or all of a container that match a tag pattern and kinds, as a dict by name."""
    fs, path_of = _fs(spark, path)
    if not fs.exists(path_of(path)):
        raise DataError(f"{path} does not exist")
    if fs.exists(path_of(f"{path}/{SIDE}")):
        return _load_one(spark, path, checksum)
    kinds = [kind] if isinstance(kind, str) else kind
    found = {}
    for status in fs.listStatus(path_of(path)):
        name = status.getPath().getName()
        stem, _, ext = name.rpartition(".")
        if status.isDirectory() and (tag is None or fnmatch.fnmatch(stem, tag)) and (kinds is None or ext in kinds) and fs.exists(path_of(f"{path}/{name}/{SIDE}")):
            found[name] = _load_one(spark, f"{path}/{name}", checksum)
    if not found:
        raise ParameterError(f"no object in {path} matches")
    return next(iter(found.values())) if len(found) == 1 and tag is not None else found


def clear(data: Trials) -> None:
    """Release cached tables of an object."""
    for df in (data.facts, data.trials, *data.extras.values()):
        df.unpersist()


def cleanup(spark: SparkSession, older_than_hours: float = 24.0) -> list[str]:
    """Delete intermediate tables that ended processes left in the shared folder; returns their paths."""
    import time

    from trialloom.plans.tables import remove, shared_folder

    folder = shared_folder(spark)
    fs, path_of = _fs(spark, folder)
    gone = []
    if fs.exists(path_of(folder)):
        for status in fs.listStatus(path_of(folder)):
            name, age = status.getPath().getName(), time.time() - status.getModificationTime() / 1000
            if name.startswith("trialloom-") and age >= older_than_hours * 3600:
                gone.append(status.getPath().toString())
                remove(spark, gone[-1])
    return gone
