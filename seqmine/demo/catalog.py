"""All demo queries and their SQL."""

from __future__ import annotations

from seqmine.demo import records, relations, segments, streams

MODULES = (segments, relations, records, streams)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
