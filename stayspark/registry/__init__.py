"""Every operator as a query over the given Parquet tables, beside equivalent SQL."""

from stayspark.registry import (  # noqa: F401
    billing,
    catalogue,
    changes,
    generator,
    increments,
    ingest,
    lookup,
    quality,
    revenue,
)
from stayspark.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
