"""Sources and sinks: panel tables, CSV folders, key/value metadata, partitioned output, manifests."""

from .scan import parse_key_values, read_csv_sources, scan_panel, site_of_path
from .sinks import header_columns, manifest, materialize, schema_conformance, shared_folder, write_partitioned

__all__ = ["header_columns", "manifest", "materialize", "parse_key_values", "read_csv_sources", "scan_panel", "schema_conformance", "shared_folder", "site_of_path", "write_partitioned"]
