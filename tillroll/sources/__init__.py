"""Sources and sinks: CSV landing, Parquet layers, and the test-table binding."""

from tillroll.sources.landing import (CSV_OPTIONS, ORDER_KEYED, ParquetShop, create_layers,
                                      land_all, land_csv, publish, publish_all, published, register_layer, write_table)
from tillroll.sources.testbind import TestShop
from tillroll.sources.versions import (Version, VersionConflict, all_versions, commit_version, current_version,
                                       drop_versions, write_version)

__all__ = ["CSV_OPTIONS", "ORDER_KEYED", "ParquetShop", "register_layer", "TestShop", "create_layers", "land_all", "land_csv",
           "publish", "publish_all", "published", "write_table", "Version", "VersionConflict", "all_versions",
           "commit_version", "current_version", "drop_versions", "write_version"]
