"""The query catalogue: each operator on the driver's tables, with DuckDB SQL where that can express it."""

from trailframe.plans import batches, evaluation, graphs, ordered, parsing, recipes, rollouts, scans, supervised

MODULES = [parsing, evaluation, ordered, batches, graphs, recipes, supervised, rollouts, scans]
QUERIES = {k: v for m in MODULES for k, v in m.catalog.queries.items()}
SQL = {k: v for m in MODULES for k, v in m.catalog.sql.items()}
