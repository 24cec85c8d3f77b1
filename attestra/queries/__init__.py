"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from __future__ import annotations

from attestra.queries import acquisition, audit, avsync, corpus, custody, evidence, features, fusion, identity, models, provenance, sinks  # noqa: F401
from attestra.queries.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "five_way_verdict"
