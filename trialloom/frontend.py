"""Calling convention of frontends: options as keywords or one dict, replay, and a selection for one call."""

from __future__ import annotations

import functools
import inspect

from trialloom.errors import ParameterError, log
from trialloom.model import Trials


class Options(dict):
    """A dict whose keys are attributes, too."""

    def __getattr__(self, name):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    __setattr__ = dict.__setitem__

    def copy(self):
        return Options(self)


def defaults(function) -> Options:
    """The optional parameters of a frontend and their defaults."""
    return Options({n: p.default for n, p in inspect.signature(function).parameters.items() if p.default is not p.empty})


YES_NO = {"yes": True, "no": False}


def frontend(function):
    """``f(data, **options)``, ``f(options, data)``, ``f(data, cfg=options)``; options of an earlier run are replayed.

    ``select=`` is applied for the call (T15: without discarding trials that
    do not cover a latency window); ``parallel`` and ``chan_per_worker`` are
    accepted and do nothing, as Spark runs everything in parallel.
    """

    @functools.wraps(function)
    def run(*args, cfg=None, select=None, parallel=None, chan_per_worker=None, **options):
        objects = [a for a in args if not isinstance(a, dict)]
        dicts = [a for a in args if isinstance(a, dict)] + ([cfg] if cfg is not None else [])
        if len(dicts) > 1:
            raise ParameterError("options were given twice")
        name = function.__name__
        given = dict(dicts[0]) if dicts else {}
        if name in given and isinstance(given[name], dict):  # the cfg of an object: replay this frontend's part
            given = dict(given[name])
        twice = set(given) & set(options)
        if twice:
            raise ParameterError(f"set in the options and as keywords: {', '.join(sorted(twice))}")
        given |= options
        for k in ("parallel", "chan_per_worker"):
            given.pop(k, None)
        select = given.pop("select", select)
        given = {k: YES_NO.get(v, v) if isinstance(v, str) else v for k, v in given.items()}
        if select is not None:
            from trialloom.operators.selection import selectdata

            objects = [selectdata.plain(o, discard=False, **select) if isinstance(o, Trials) else o for o in objects]
        out = function(*objects, **given)
        if isinstance(out, Trials):
            replay = {k: v for k, v in given.items() if not isinstance(v, Trials)} | ({"select": select} if select else {})
            out = out.having(cfg={**out.cfg, name: replay})
        log.debug("%s %s", name, given)
        return out

    run.plain = function
    return run
