"""Query catalogue over the driver tables."""


def load():
    """All registered queries."""
    from matchstrata.catalog import exposure_queries, location_queries, model_queries, registry_queries, source_queries  # noqa: F401
    from matchstrata.catalog.base import CATALOG

    return CATALOG
