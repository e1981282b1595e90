"""All query modules, imported for their registrations."""

from relweave.plans import catalog_features, catalog_models, catalog_rows, catalog_tables  # noqa: F401
from relweave.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
