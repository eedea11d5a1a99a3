"""Registered queries over the given tables and the SQL they are held against."""

from . import forms, maintenance, notes, retrieval, storage  # noqa: F401

#: Those of ``forms`` are registered with ``notes``.
QUERIES = {**retrieval.QUERIES, **maintenance.QUERIES, **storage.QUERIES, **notes.QUERIES}
ORACLES = {**retrieval.ORACLES, **maintenance.ORACLES, **storage.ORACLES, **notes.ORACLES}
