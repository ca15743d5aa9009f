"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from . import (catalog_audit, catalog_national, catalog_schools, catalog_text, oracle_audit, oracle_national, oracle_schools, oracle_text)

QUERIES = {**catalog_national.QUERIES, **catalog_schools.QUERIES, **catalog_audit.QUERIES, **catalog_text.QUERIES}
ORACLE = {**oracle_national.SQL, **oracle_schools.SQL, **oracle_audit.SQL, **oracle_text.SQL}
