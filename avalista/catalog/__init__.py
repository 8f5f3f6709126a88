"""Every operator as a query over the test tables, with an SQL twin where one exists."""

from avalista.catalog.registry import QUERIES, SQL  # noqa: F401
from avalista.catalog import (  # noqa: F401  (importing registers the queries)
    evaluation,
    features,
    joins,
    models,
    portfolio,
    pricing,
    rules,
    sources,
)
