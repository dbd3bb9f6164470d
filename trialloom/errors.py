"""Errors and warnings of the package."""

from __future__ import annotations

import logging

log = logging.getLogger("trialloom")


class TrialloomError(Exception):
    """Base of all errors raised on purpose."""


class DataError(TrialloomError, ValueError):
    """An object or table that cannot be used this way."""


class ParameterError(TrialloomError, ValueError):
    """A parameter outside its range."""


class ParameterTypeError(TrialloomError, TypeError):
    """A parameter of the wrong type."""


def scalar(value, name: str, lo: float | None = None, hi: float | None = None, integer: bool = False):
    """``value`` if it is a number in [lo, hi]."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ParameterTypeError(f"{name} must be a number")
    if value != value or (integer and int(value) != value) or (lo is not None and value < lo) or (hi is not None and value > hi):
        raise ParameterError(f"{name} must be {'an integer' if integer else 'a number'} from {lo} to {hi}")
    return value


def choice(value, name: str, options):
    if value not in options:
        raise ParameterError(f"{name} must be one of {', '.join(map(str, options))}")
    return value


def vector(value, name: str, n: int | None = None, lo: float | None = None, hi: float | None = None, ordered: bool = False) -> list:
    """``value`` as a list of finite numbers in [lo, hi]."""
    import numpy as np

    try:
        a = np.asarray(value, float)
    except (TypeError, ValueError) as e:
        raise ParameterTypeError(f"{name} must hold numbers") from e
    if a.ndim != 1 or (n is not None and len(a) != n) or np.isnan(a).any() or (lo is not None and (a < lo).any()) or (hi is not None and (a > hi).any()):
        raise ParameterError(f"{name} must hold {n or 'some'} numbers from {lo} to {hi}")
    if ordered and (np.diff(a) < 0).any():
        raise ParameterError(f"{name} must be in ascending order")
    return a.tolist()


def data_object(value, name: str = "data", kind: str | tuple[str, ...] | None = None, empty: bool | None = None):
    """``value`` if it is a data object, of a kind if one is asked for, and empty or not, if that is."""
    from trialloom.model import Trials

    if not isinstance(value, Trials):
        raise ParameterTypeError(f"{name} must be a data object")
    kinds = (kind,) if isinstance(kind, str) else kind
    if kinds is not None and value.kind not in kinds:
        raise DataError(f"{name} must be {' or '.join(kinds)} data, not {value.kind}")
    if empty is not None and value.trials.isEmpty() != empty:
        raise DataError(f"{name} must {'be empty' if empty else 'have trials'}")
    return value


def object_path(path: str) -> dict:
    """Parts of the path of a saved object or a container: folder, container, basename, tag and kind."""
    import os

    if not isinstance(path, str):
        raise ParameterTypeError("a path must be a text")
    if not path.strip("/"):
        raise ParameterError("the path is empty")
    folder, name = os.path.split(path.rstrip("/"))
    stem, _, kind = name.rpartition(".")
    holder = os.path.basename(folder)
    if not stem or kind not in ("analog", "spectral", "cross", "timelock", "spike", "event"):
        return {"folder": folder, "container": name, "basename": None, "tag": None, "kind": None}
    return {"folder": os.path.dirname(folder), "container": holder, "basename": name, "tag": stem, "kind": kind}


def ineffective(given: dict, used: set[str], what: str) -> None:
    """Warn of parameters that were set but do nothing for ``what``."""
    for name in sorted(set(given) - used):
        if given[name] is not None:
            log.warning("parameter %s has no effect for %s", name, what)
