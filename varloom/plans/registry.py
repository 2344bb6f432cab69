"""All queries of the library outside of its subpackage for training text."""

from varloom.plans import base, evidence, family, files, filters, frames, places, readers, regulation, review, scoring, state  # noqa: F401

QUERIES, ORACLE_SQL = base.QUERIES, base.ORACLE_SQL
