"""Fields of JSON records that change over time: one table, and a report of every change.

Each payload is read as a map from leaf path to raw type and value, and the
types of each path are added up by file: a file's path-type statistics.  From
them follow the report, by comparing a file's with those of the file before it
in its series, and, added up over all files, the consistent table's schema.

The files are cut by rank of (series, time) into ranges of about equally many,
whatever their times, and every range is swept in order.  What a sweep cannot
know, as it depends on files before its range, it hands on: its first file, and
changes of paths whose type it has not met yet.  A second sweep over these few
rows, with the state in which each range ends, settles them.  No series has to
fit in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialloom.plans.tables import materialise

FILES_PER_RANGE = 20_000
DTYPE = "\0data"  # stands for the path of the NumPy dtype among the paths of a file

STATISTICS = "array<struct<path:string,type:string,n:bigint,value:string>>"


def _type_of(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "double"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    inner = {t for t in map(_type_of, v) if t}
    if not inner:
        return None
    if inner == {"integer", "double"}:
        inner = {"double"}
    return f"array<{inner.pop() if len(inner) == 1 else 'mixed'}>"


def _leaves_of(node: dict, above: str = "") -> Iterator[tuple[str, object]]:
    for name, v in node.items():
        path = f"{above}.{name}" if above else name
        if isinstance(v, dict):
            yield from _leaves_of(v, path)
        else:
            yield path, v


def _dtype_name(text) -> str | None:
    """Canonical name of a NumPy dtype; another text stays as it is."""
    if isinstance(text, list) and len(text) == 1:
        text = text[0]
    if not isinstance(text, str):
        return None
    try:
        return np.dtype(text).str
    except TypeError:
        return text


def path_values(text: str | None) -> dict[str, tuple[str | None, str | None]] | None:
    """path -> (raw type, value as JSON) of a payload; null types and values where it says nothing; None if it is no JSON object."""
    try:
        node = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(node, dict):
        return None
    out = {}
    for path, v in _leaves_of(node):
        kind = _type_of(v)
        out[path] = (kind, json.dumps(v, sort_keys=True, ensure_ascii=False) if kind else None)
    out[DTYPE] = (_dtype_name(node.get("data_dtype")), None)
    return out


def records_once(records: DataFrame, key: str, series: list[Column], at: str, payload: str) -> DataFrame:
    """(series, us, key, payload) of every record with a key and a payload; of records of one key only the first by series, time and content.

    A series is the tuple of its parts as one string array, in which null is a
    value like others; us is the time in microseconds.  Exact copies stay, if
    no other record has their key.
    """
    rows = records.where(F.col(key).isNotNull() & F.col(payload).isNotNull()).select(
        F.array(*[F.coalesce(c.cast("string"), F.lit("\0null")) for c in series]).alias("series"), F.unix_micros(at).alias("us"), F.col(key).alias("key"), F.col(payload).alias("payload")
    )
    # only hashes are shuffled to find keys whose records differ
    what = F.struct("series", "us", F.xxhash64("payload").alias("h"))
    clash = rows.groupBy("key").agg(F.min(what).alias("keep"), F.max(what).alias("top")).where("keep <> top OR (keep.us IS NULL) <> (top.us IS NULL)").select(F.col("key").alias("k_"), "keep")
    clash = materialise(clash)
    if clash.isEmpty():
        return rows
    met = rows.join(clash, F.col("key") == F.col("k_"), "left")
    return met.where(F.col("keep").isNull() | what.eqNullSafe(F.col("keep"))).select("series", "us", "key", "payload")


def file_statistics(records: DataFrame, key: str, series: list[Column], at: str, payload: str) -> DataFrame:
    """(series, us, key, stats): the path-type statistics of every file that can be parsed, each key once."""

    def read(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            leaves = path_values(text)
            out.append(None if leaves is None else [{"path": p, "type": t, "n": 1, "value": v} for p, (t, v) in leaves.items() if p != DTYPE])
        return pd.Series(out)

    once = records_once(records, key, series, at, payload).groupBy("key").agg(F.first(F.struct("series", "us", "payload")).alias("r"))
    parsed = once.select("r.series", "r.us", "key", F.pandas_udf(read, STATISTICS)("r.payload").alias("stats"))
    return parsed.where("stats IS NOT NULL")


# --- the report ------------------------------------------------------------------------------------------------------


def _plain(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def _pair(gone: list[dict], new: list[dict]) -> list[tuple[dict, dict]]:
    """Renamed pairs: same content first, then the same name written differently with the same kind of value."""
    scored = []
    for i, a in enumerate(gone):
        for j, b in enumerate(new):
            name = _plain(a["path"]) == _plain(b["path"])
            last = _plain(a["path"].rsplit(".", 1)[-1]) == _plain(b["path"].rsplit(".", 1)[-1])
            kind = a["type"] is None or b["type"] is None or a["type"] == b["type"]
            value = a["value"] is not None and a["value"] == b["value"]
            if value or (name and kind):
                parent = a["path"].rpartition(".")[0] == b["path"].rpartition(".")[0]
                scored.append((-(4 * name + 2 * value + last), not parent, a["path"], b["path"], i, j))
    used_a, used_b, pairs = set(), set(), []
    for *_, i, j in sorted(scored):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            pairs.append((gone[i], new[j]))
    return pairs


class Sweep:
    """The files of one series in order: what each path's type and value were last, and which paths the file before had."""

    def __init__(self, complete: bool):
        self.complete = complete  # no file of the series lies before this range
        self.before: set[str] | None = None
        self.seen: dict[str, tuple[str, str | None]] = {}

    def changes(self, now: dict) -> tuple[list[tuple[str, str, str]], dict]:
        """(change, old, new) of the next file, and what is open: types and sides that depend on files before this range."""
        found, later = [], {}
        if self.before is None:
            if not self.complete:
                later["first"] = now
        else:
            found, later = self.compare(now)
        self.take(now)
        return found, later

    def compare(self, now: dict) -> tuple[list[tuple[str, str, str]], dict]:
        found, later = [], {}
        for path in self.before & now.keys():
            kind = now[path][0]
            if kind is None:
                continue
            last = self.seen.get(path)
            if last is None:
                if not self.complete:
                    later.setdefault("types", {})[path] = kind
            elif last[0] != kind:
                name = "data" if path == DTYPE else path
                found.append(("retyped", name, name))
        gone = sorted(self.before - now.keys())
        new = [{"path": p, "type": now[p][0], "value": now[p][1]} for p in sorted(now.keys() - self.before)]
        old = [dict(zip(("path", "type", "value"), (p, *self.seen.get(p, (None, None))))) for p in gone]
        if new and not self.complete and any(p not in self.seen for p in gone):
            later["sides"] = [old, new]
        else:
            found += sided(old, new)
        return found, later

    def take(self, now: dict) -> None:
        self.before = set(now)
        for path, (kind, value) in now.items():
            if kind is not None:
                self.seen[path] = (kind, value)


def sided(old: list[dict], new: list[dict]) -> list[tuple[str, str, str]]:
    """What went and what came, paired as renamed where it is the same."""
    pairs = _pair(old, new) if old and new else []
    left, right = {a["path"] for a, _ in pairs}, {b["path"] for _, b in pairs}
    found = [("renamed", a["path"], b["path"]) for a, b in pairs]
    found += [("removed", a["path"], "") for a in old if a["path"] not in left]
    return found + [("added", "", b["path"]) for b in new if b["path"] not in right]


def _sweep_ranges(schema: pa.Schema):
    """Files of a range, in order, to changes and, for the second sweep, what is open and the state at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, sweep, last, seq = None, None, None, 0
        out: list[tuple] = []
        part = None
        for batch in batches:
            for s, key, payload, part in zip(*(c.to_pylist() for c in batch.columns)):
                if s != series:
                    # only the first series of a range can have begun before it
                    sweep, series, last = Sweep(complete=series is not None), s, None
                if last is not None and key == last:
                    continue  # delivered again
                last = key
                now = path_values(payload)
                if now is None:
                    continue
                found, later = sweep.changes(now)
                out += [(key, *x, None, None, None, None) for x in found]
                if later:
                    out.append((key, None, None, None, s, part, seq, json.dumps(later)))
                    seq += 1
            if len(out) > 10_000:
                yield _batch(out, schema)
                out = []
        if sweep is not None and sweep.before is not None:
            # the last series may go on
            out.append((None, None, None, None, series, part, seq, json.dumps({"end": [sorted(sweep.before), sweep.seen]})))
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sweep_open(schema: pa.Schema):
    """Open rows of a series, in order of range, to its other changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, sweep = None, None
        for batch in batches:
            out: list[tuple] = []
            for s, key, body in zip(*(c.to_pylist() for c in batch.columns)):
                if s != series:
                    sweep, series = Sweep(complete=True), s
                row = json.loads(body)
                if "end" in row:
                    before, seen = row["end"]
                    sweep.before = set(before)
                    sweep.seen |= {p: tuple(x) for p, x in seen.items()}
                elif "first" in row:
                    if sweep.before is not None:
                        out += [(key, *x) for x in sweep.compare({p: tuple(x) for p, x in row["first"].items()})[0]]
                else:
                    for path, kind in row.get("types", {}).items():
                        if sweep.seen.get(path, (kind,))[0] != kind:
                            name = "data" if path == DTYPE else path
                            out.append((key, "retyped", name, name))
                    if "sides" in row:
                        old, new = row["sides"]
                        for x in old:
                            if x["type"] is None:
                                x["type"], x["value"] = sweep.seen.get(x["path"], (None, None))
                        out += [(key, *x) for x in sided(old, new)]
            if out:
                yield _batch(out, schema)

    return run


def field_changes(records: DataFrame, key: str, series: list[Column], at: str, payload: str, per_range: int = FILES_PER_RANGE) -> DataFrame:
    """(key, change, old_field, new_field): every difference of a record from the one before it in its series.

    The order is by ``at``, then ``key``; null times come first.  Repeated
    rows of a key count once (of clashing ones the first by series, time and
    content); records with a null key or a payload that is null, cut off or no
    JSON object do not count at all.  A null or empty array says nothing about
    a field's type, which stays as last seen under that path.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    once = records_once(records, key, series, at, payload)
    spark = records.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, -(-once.count() // per_range))
    placed = once.repartitionByRange(ranges, "series", "us", "key").sortWithinPartitions("series", "us", "key")
    key_type = dict(once.dtypes)["key"]
    report = f"key {key_type}, change string, old_field string, new_field string"
    opened = "series array<string>, part int, seq long, body string"
    arrow = _arrow_schema(spark, f"{report}, {opened}")
    swept = materialise(placed.select("series", "key", "payload", F.spark_partition_id().alias("part")).mapInArrow(_sweep_ranges(arrow), f"{report}, {opened}"))
    rows = swept.where("change IS NULL").repartition("series").sortWithinPartitions("series", "part", "seq").select("series", "key", "body")
    settled = rows.mapInArrow(_sweep_open(_arrow_schema(spark, report)), report)
    return swept.where("change IS NOT NULL").select("key", "change", "old_field", "new_field").unionByName(settled)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# --- one table -------------------------------------------------------------------------------------------------


def path_types(files: DataFrame) -> DataFrame:
    """Raw types of each path over all files' statistics: (path, type, n, first_key, last_key)."""
    leaves = files.select("key", F.explode("stats").alias("l"))
    return leaves.groupBy(F.col("l.path").alias("path"), F.coalesce("l.type", F.lit("null")).alias("type")).agg(F.sum("l.n").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def one_field(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(old_field, new_field, n) of renames that never are two fields: no file holds both paths."""
    links = changes.where("change = 'renamed'").groupBy("old_field", "new_field").agg(F.count(F.lit(1)).alias("n"))
    links = materialise(links)
    ends = links.select("old_field", "new_field", F.explode(F.array("old_field", "new_field")).alias("path"))
    held = files.select("key", F.explode("stats.path").alias("path")).join(ends, "path")
    both = held.groupBy("key", "old_field", "new_field").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("old_field", "new_field").distinct()
    return links.join(both, ["old_field", "new_field"], "left_anti")


SPARK_TYPES = {"string": "string", "boolean": "boolean", "integer": "bigint", "double": "double", "array<string>": "array<string>", "array<boolean>": "array<boolean>", "array<integer>": "array<bigint>", "array<double>": "array<double>"}
MOST_PATHS = 20_000


def canonical_fields(links: DataFrame, types: DataFrame, most: int = MOST_PATHS) -> dict[str, tuple[str, str]]:
    """path -> (consistent field, type): paths that ``links`` (old_field, new_field) join share a field, types the most frequent one.

    The schema, unlike the records, is held on the driver: at most ``most``
    distinct (path, type) pairs and renames, beyond which an error is raised.
    Of joined paths the most frequent gives the field's name.  An integer field
    that also holds doubles is double.
    """
    stats = types.limit(most + 1).collect()
    pairs = links.select("old_field", "new_field").limit(most + 1).collect()
    if max(len(stats), len(pairs)) > most:
        raise ValueError(f"more than {most} distinct paths: these records have no common schema")
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent.setdefault(parent[x], parent[x])
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    seen: dict[str, dict[str, int]] = {}
    uses: dict[str, int] = {}
    for path, kind, n, *_ in stats:
        uses[path] = uses.get(path, 0) + n
        if kind in SPARK_TYPES:
            of = seen.setdefault(root(path), {})
            of[kind] = of.get(kind, 0) + n
    names: dict[str, str] = {}
    for path in sorted(uses, key=lambda p: (-uses[p], p)):
        names.setdefault(root(path), path)
    out = {}
    for path in uses:
        of = seen.get(root(path), {"string": 1})
        kind = max(sorted(of), key=lambda k: of[k])
        for a, b in (("integer", "double"), ("array<integer>", "array<double>")):
            if kind == a and of.get(b):
                kind = b
        out[path] = (names[root(path)], SPARK_TYPES[kind])
    return out


def _cast_items(items: Column, inner: str) -> Column:
    return F.transform(items, lambda x: x.try_cast(inner))


def typed_table(files: DataFrame, fields: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The consistent table, one row per record, and (key, path, field, type, wanted, value, reason) of every value that is not in it.

    A column is null where the record has no value for it, or none that can be
    cast; single values and arrays of one element are cast into one another.
    If two paths of a record share a field, the first by name wins.  reason is
    ``cast`` for a value that failed to be cast, ``shared`` for one that lost its
    field to another path.
    """
    spark = files.sparkSession
    schema = spark.createDataFrame([(p, f, t) for p, (f, t) in sorted(fields.items())], "path string, field string, wanted string")
    leaves = files.select("key", F.explode("stats").alias("l")).where("l.value IS NOT NULL").select("key", "l.path", "l.type", "l.value")
    placed = leaves.join(schema, "path")
    text = F.when(F.col("type") == "string", F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]).otherwise(F.col("value"))
    placed = placed.withColumn("text", F.when(F.col("type").startswith("array") & ~F.col("wanted").startswith("array"), F.regexp_replace(F.col("value"), r'^\[\s*"?|"?\s*\]$', "")).otherwise(text))
    whole = F.when(F.col("type").startswith("array"), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    columns, good = [], F.lit(False)
    for wanted in sorted({t for _, t in fields.values()}):
        if wanted.startswith("array"):
            items = F.from_json(whole, "array<string>")
            cast = _cast_items(items, wanted[6:-1])
            ok = ~F.exists(F.arrays_zip(items.alias("i"), cast.alias("c")), lambda z: z["i"].isNotNull() & z["c"].isNull())
        else:
            cast = F.col("text").try_cast(wanted)
            ok = cast.isNotNull()
        good = good | ((F.col("wanted") == wanted) & ok)
        columns.append((wanted, F.when(F.col("wanted") == wanted, cast)))
    checked = materialise(placed.withColumn("good", F.coalesce(good, F.lit(False))))
    named: dict[str, str] = {}  # column names differ in more than case
    for f, _ in sorted(set(fields.values())):
        name, i = f.replace(".", "__"), 1
        while (name if i == 1 else f"{name}__{i}").lower() in named:
            i += 1
        named[(name if i == 1 else f"{name}__{i}").lower()] = f
    names = {f: (f.replace(".", "__") + low[len(f.replace(".", "__")) :]) for low, f in named.items()}
    wide = checked.groupBy("key").agg(
        *[F.min_by(dict(columns)[t], F.when((F.col("field") == f) & F.col("good"), F.col("path"))).alias(names[f]) for f, t in sorted(set(fields.values()))]
    )
    wide = files.select("key").join(wide, "key", "left")  # a record without any value is a row, too
    columns_out = ["key", "path", "field", "type", "wanted", "value"]
    failed = checked.where(~F.col("good")).select(*columns_out, F.lit("cast").alias("reason"))
    doubled = checked.where("good").groupBy("key", "field").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("key").alias("k_"), F.col("field").alias("f_"), "first")
    lost = checked.where("good").join(doubled, (F.col("key") == F.col("k_")) & (F.col("field") == F.col("f_"))).where(F.col("path") != F.col("first"))
    return wide, failed.unionByName(lost.select(*columns_out, F.lit("shared").alias("reason")))
