"""All registered queries of the engine proper."""

from __future__ import annotations

from skerry.operators import search
from skerry.plans import core_problems, core_queries
from skerry.sources import trees


def queries():
    return {**core_problems.QUERIES, **core_queries.QUERIES}


def oracle_sql():
    return {**core_problems.ORACLE, **core_queries.ORACLE}


def flagship(spark, sf_dir):
    """The twenty best results of ``doc .md`` over the documents as files."""
    return search.find(trees.documents(spark, sf_dir), core_queries.plan("doc .md"), 20)
