"""Writers. None of them ever writes over its own input."""
from leafmill.sinks.files import compact_dataset, export_links_txt, export_tables_csv, write_derived

__all__ = ["compact_dataset", "export_links_txt", "export_tables_csv", "write_derived"]
