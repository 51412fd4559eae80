"""All registered queries of the library's own operators, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partita.plans import analysis, models, preparation, streams  # noqa: F401  they register their queries
from partita.plans.registry import ORACLE_SQL, QUERIES, Tables

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the clusters of events differ in value? A latent class model, labels, and their means."""
    return models.event_clusters(Tables(spark, sf_dir))
