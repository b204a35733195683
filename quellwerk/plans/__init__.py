"""Queries on the test tables."""

from __future__ import annotations


def registry():
    """All core queries and their SQL."""
    from quellwerk.plans import analytics, catalog, checks, crawl, dates, events, extra, fields, history, ingest, joins, monitor, outside, rules, scalar, selection, stateful, summaries  # noqa: F401

    return dict(catalog.QUERIES), dict(catalog.SQL)
