from quarry.sources.tables import TABLES, Catalog  # noqa: F401
