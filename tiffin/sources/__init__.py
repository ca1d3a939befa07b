"""Table schemas, loading/writing, and the TPC-H derivation used in tests."""

from tiffin.sources.catalog import read_catalog_tables, write_catalog_tables
from tiffin.sources.derive import from_tpch
from tiffin.sources.schemas import SCHEMAS
from tiffin.sources.tables import (
    TABLE_NAMES,
    Intermediates,
    Tables,
    conform,
    read_tables,
    register_views,
    write_tables,
)

__all__ = ["SCHEMAS", "TABLE_NAMES", "Intermediates", "Tables", "conform", "from_tpch", "read_catalog_tables",
           "read_tables", "register_views", "write_catalog_tables", "write_tables"]
