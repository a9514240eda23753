"""Every query that does not depend on the text subpackage, with its SQL."""

from seriesforge.plans import catalog, fits, instrument, maintenance, names, nights, noise, nulls, spectra, statistics, streams, surface  # noqa: F401  each registers its queries
from seriesforge.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
