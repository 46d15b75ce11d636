"""All registered queries of the core engine and their SQL."""

from looploom.plans import algorithms, files, relational

QUERIES: dict = {**relational.QUERIES, **algorithms.QUERIES, **files.QUERIES}
ORACLE_SQL: dict = {**relational.ORACLE_SQL, **algorithms.ORACLE_SQL, **files.ORACLE_SQL}
