"""Arithmetic between objects, arrays and scalars, equality, and joining along channels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialloom.errors import DataError, ParameterError, ParameterTypeError
from trialloom.model import CONTINUOUS, Trials

OPERATORS = ("+", "-", "*", "/", "**")


def complex_op(op: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Real and imaginary part of a ∘ b."""
    (x, y), (u, v) = a, b
    if op == "+":
        return x + u, y + v
    if op == "-":
        return x - u, y - v
    if op == "*":
        return x * u - y * v, x * v + y * u
    if op == "/":
        n = u * u + v * v
        return F.try_divide(x * u + y * v, n), F.try_divide(y * u - x * v, n)
    log_r, arg = F.log(F.hypot(x, y)), F.atan2(y, x)
    size, turn = F.exp(u * log_r - v * arg), v * log_r + u * arg
    zero = (x == 0) & (y == 0)
    return F.when(zero, F.when((u == 0) & (v == 0), 1.0).otherwise(0.0)).otherwise(size * F.cos(turn)), F.when(zero, 0.0).otherwise(size * F.sin(turn))


def real_op(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "**": lambda: F.pow(a, b)}[op]()


def arithmetic(data: Trials, op: str, other, swapped: bool = False) -> Trials:
    """``data`` ∘ ``other`` value by value; ``swapped`` puts the operand first.

    An operand is a finite number (no division by zero), an array that
    broadcasts to each trial's shape, or an object of the same kind, rate and
    number of trials, whose k-th trial goes with the k-th.  Time-locked
    results count as analog values (their average is gone).
    """
    if op not in OPERATORS:
        raise ParameterError(f"unknown operator {op!r}")
    if data.kind not in CONTINUOUS:
        raise DataError("arithmetic needs continuous data")
    if isinstance(other, Trials):
        return _with_object(data, op, other, swapped)
    if isinstance(other, (bool, str)) or other is None:
        raise ParameterTypeError("the operand must be a number, an array or an object")
    if np.ndim(other) == 0:
        z = complex(other)
        if not (math.isfinite(z.real) and math.isfinite(z.imag)):
            raise ParameterError("the operand must be finite")
        if op == "/" and z == 0 and not swapped:
            raise ParameterError("division by zero")
        return data.having(f"{op} {other}", facts=_apply(data, op, F.lit(z.real), F.lit(z.imag) if z.imag else None, swapped))
    return _with_array(data, op, np.asarray(other), swapped)


def _apply(data: Trials, op: str, re: Column, im: Column | None, swapped: bool, facts=None):
    facts = data.facts if facts is None else facts
    keys = ["trial_id", *data.axes]
    if "im" in data.values:
        a, b = (F.col("re"), F.col("im")), (re, im if im is not None else F.lit(0.0))
        x, y = complex_op(op, *((b, a) if swapped else (a, b)))
        return facts.select(*keys, x.alias("re"), y.alias("im"))
    if im is not None:
        raise DataError("a complex operand needs complex data")
    v = data.values[0]
    a, b = F.col(v), re
    return facts.select(*keys, (real_op(op, b, a) if swapped else real_op(op, a, b)).alias(v))


def _with_array(data: Trials, op: str, array: np.ndarray, swapped: bool) -> Trials:
    tail = data.shape_tail()
    if tail is None:
        sizes = [tuple(r) for r in data.facts.groupBy("trial_id").agg(*[F.countDistinct(a).alias(a) for a in data.axes]).select(*data.axes).distinct().collect()]
    else:  # by the trial table and the labels, which are small
        sizes = [(r["n"], *tail) for r in data.lengths().select("n").distinct().collect()]
    for shape in sizes:
        try:
            fits = np.broadcast_shapes(array.shape, shape) == shape
        except ValueError:
            fits = False
        if not fits:
            raise ParameterError(f"an array of shape {array.shape} does not broadcast to a trial of shape {shape}")
    full = array.reshape((1,) * (len(data.axes) - array.ndim) + array.shape)
    at = F.lit(0)
    for axis, n in zip(data.axes, full.shape):
        at = at * n + (F.col(axis) if n > 1 else F.lit(0))

    def column(values):
        if values.size <= 4096:  # part of the plan
            return F.element_at(F.array(*[F.lit(float(x)) for x in values.ravel()]), at + 1)
        return None

    cplx = np.iscomplexobj(full)
    re = column(full.real)
    if re is not None:
        return data.having(f"{op} array", facts=_apply(data, op, re, column(full.imag) if cplx else None, swapped))
    rows = data.spark.createDataFrame([(i, float(z.real), float(z.imag)) for i, z in enumerate(full.ravel().astype(complex))], "at_ int, re_ double, im_ double")
    facts = data.facts.withColumn("at_", at.cast("int")).join(rows, "at_")  # the planner broadcasts it by its size
    return data.having(f"{op} array", facts=_apply(data, op, F.col("re_"), F.col("im_") if cplx else None, swapped, facts))


def _with_object(data: Trials, op: str, other: Trials, swapped: bool) -> Trials:
    if data.kind != other.kind or data.samplerate != other.samplerate or data.values != other.values:
        raise DataError("objects differ in kind, sampling rate, or are real and complex")
    keys = ["trial_id", *data.axes]
    tails = data.shape_tail(), other.shape_tail()
    if None in tails:
        shape = [F.count(F.lit(1)).alias("n"), *[F.max(a).alias(a) for a in data.axes]]
        a, b = (x.facts.groupBy("trial_id").agg(*shape) for x in (data, other))
    else:
        a, b = data.lengths(), other.lengths()
    if tails[0] != tails[1] or not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise DataError("objects differ in the number or shape of their trials")
    names = {v: f"{v}_" for v in data.values}
    right = other.facts.select(*keys, *[F.col(v).alias(n) for v, n in names.items()])
    met = data.facts.join(right, keys)
    re = F.col(names.get("re", f"{data.values[0]}_"))
    return data.having(f"{op} object", facts=_apply(data, op, re, F.col("im_") if "im" in names else None, swapped, met))


def equal(a, b, rtol: float = 1e-5, atol: float = 1e-8) -> bool:
    """Same kind, labels, info and trials, and values equal within a tolerance (NaN equals NaN)."""
    if not isinstance(a, Trials) or not isinstance(b, Trials):
        return False
    if (a.kind, a.samplerate, a.labels, a.info, a.values) != (b.kind, b.samplerate, b.labels, b.info, b.values):
        return False
    if not a.trials.exceptAll(b.trials).isEmpty() or not b.trials.exceptAll(a.trials).isEmpty():
        return False
    keys = [c for c in a.facts.columns if c not in a.values]
    if not a.values:
        return a.facts.exceptAll(b.facts).isEmpty() and b.facts.exceptAll(a.facts).isEmpty()
    met = a.facts.withColumn("l_", F.lit(1)).join(b.facts.select(*keys, *[F.col(v).alias(f"{v}_") for v in a.values], F.lit(1).alias("r_")), keys, "full")
    off = F.col("l_").isNull() | F.col("r_").isNull()
    for v in a.values:
        x, y = F.col(v), F.col(f"{v}_")
        same = (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= atol + rtol * F.abs(y)) | (x == y)
        off = off | ~F.coalesce(same, x.isNull() & y.isNull())
    return met.where(off).isEmpty()


def concat(a: Trials, b: Trials, dim: str = "channel") -> Trials:
    """The channels of two objects side by side, trial by trial; labels of both are kept."""
    if dim != "channel":
        raise ParameterError("objects can be joined along channels")
    if a.kind != b.kind or a.kind not in ("analog", "spectral") or a.samplerate != b.samplerate:
        raise DataError("objects differ in kind or sampling rate")
    if not a.trials.exceptAll(b.trials).isEmpty() or not b.trials.exceptAll(a.trials).isEmpty():
        raise DataError("objects differ in their trials")
    n = len(a.labels["channel"])
    shifted = b.facts.withColumn("channel_id", (F.col("channel_id") + n).cast("int"))
    return a.having("channels joined", facts=a.facts.unionByName(shifted), labels={**a.labels, "channel": [*a.labels["channel"], *b.labels["channel"]]})
