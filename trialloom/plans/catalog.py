"""All queries of the core and their SQL."""

from __future__ import annotations

from trialloom.plans import dataops, reference

FLAGSHIP = "ref_trial_mean_var"


def queries() -> dict:
    return {**reference.QUERIES, **dataops.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**reference.SQL, **dataops.SQL}
