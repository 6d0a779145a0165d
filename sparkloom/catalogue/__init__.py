"""The query catalogue over the test tables."""

from sparkloom.catalogue import charts, contracts, corpus, evaluation, operators, profiles, tables
from sparkloom.catalogue.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "charts", "contracts", "corpus", "evaluation", "operators", "profiles", "tables"]
