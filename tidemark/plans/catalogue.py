"""Named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from . import daily, inferences, models, networks, scores, streams, study, texts

PLANS = (daily, texts, scores, networks, streams, inferences, study, models)


def queries() -> dict:
    return {k: f for p in PLANS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in PLANS for k, q in p.ORACLE.items()}
