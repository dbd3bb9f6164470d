"""Complex numbers as columns: structs of re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cplx(re, im=0.0) -> Column:
    re, im = (x if isinstance(x, Column) else F.lit(float(x)) for x in (re, im))
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def mul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


def magnitude(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])
