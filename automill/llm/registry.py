"""All queries of this subpackage and the SQL of those that SQL can express."""

from automill.llm import queries_licenses, queries_manifest, queries_mining, queries_models, queries_native, queries_near, queries_web

QUERIES = {**queries_native.QUERIES, **queries_models.QUERIES, **queries_near.QUERIES, **queries_web.QUERIES, **queries_manifest.QUERIES, **queries_licenses.QUERIES, **queries_mining.QUERIES}
ORACLES = {**queries_native.ORACLES, **queries_models.ORACLES, **queries_web.ORACLES, **queries_manifest.ORACLES, **queries_mining.ORACLES}
