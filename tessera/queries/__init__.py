"""Registered queries, each with the SQL that an independent engine answers it with."""

from __future__ import annotations

from . import exotic, functions, programs, relational, suites, typed


def queries() -> dict:
    return {k: v for m in (relational, suites, typed, functions, exotic, programs) for k, v in m.queries().items()}


def oracle_sql() -> dict:
    return {k: v for m in (relational, suites, typed, functions, exotic, programs) for k, v in m.oracle_sql().items()}
