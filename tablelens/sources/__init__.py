from tablelens.sources.delimited import first_line_counts, read_table, sniff_delimiter, write_delimited
from tablelens.sources.prefix import first_file_rows, first_records, prefix_role_table
from tablelens.sources.sinks import commit_report, read_report, write_report
from tablelens.sources.tables import TABLES, load_tables, read_parquet, table_path

__all__ = [
    "TABLES",
    "commit_report",
    "first_file_rows",
    "first_line_counts",
    "first_records",
    "load_tables",
    "prefix_role_table",
    "read_parquet",
    "read_report",
    "read_table",
    "sniff_delimiter",
    "table_path",
    "write_delimited",
    "write_report",
]
