"""All registered queries, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import arrivals, corpora, documents, dynamics, evaluation, modelling, reporting, sequences

MODULES = (documents, corpora, evaluation, reporting, sequences, dynamics, arrivals, modelling)


def queries():
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
