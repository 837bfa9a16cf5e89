"""Training-data operators.

Nothing else in the package imports this subpackage.  ``queries()`` and
``oracle_sql()`` list what ``__spark_entry__.py`` registers when it is present.
"""

from __future__ import annotations


def queries():
    from caseflow.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from caseflow.llm.registry import ORACLE_SQL

    return dict(ORACLE_SQL)
