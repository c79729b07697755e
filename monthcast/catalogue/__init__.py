"""Every operator as a runnable query over the supplied tables, with its SQL check."""

from monthcast.catalogue import (  # noqa: F401
    cleaning,
    ensembles,
    features,
    forecasts,
    holdout,
    joins,
    jobs,
    quality,
    reports,
    series,
    sources,
)
from monthcast.catalogue.registry import QUERIES, SQL  # noqa: F401
