"""Named queries over the driver's tables, with their SQL equivalents."""

from chainloom.plans import encoding, models, scaling

QUERIES: dict = scaling.QUERIES | encoding.QUERIES | models.QUERIES
ORACLE_SQL: dict = scaling.ORACLE_SQL | encoding.ORACLE_SQL | models.ORACLE_SQL
