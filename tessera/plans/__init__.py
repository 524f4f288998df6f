"""Named query plans: each is (spark, sf_dir) -> DataFrame, with an optional
DuckDB oracle SQL over the same tables."""

from tessera.plans.registry import QUERIES, ORACLES, load_all  # noqa: F401
