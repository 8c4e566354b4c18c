from salesledger.sources.csv import SEQ_COL, CsvTable, all_rejects, read_csv_groups, read_csv_text, scan_csv
from salesledger.sources.ledger_store import LEDGER_SCHEMA, LedgerTable
from salesledger.sources.sinks import json_rows, render_rows, report_paths, write_csv, write_report

__all__ = [
    "CsvTable",
    "LEDGER_SCHEMA",
    "LedgerTable",
    "SEQ_COL",
    "all_rejects",
    "json_rows",
    "read_csv_groups",
    "read_csv_text",
    "render_rows",
    "report_paths",
    "scan_csv",
    "write_csv",
    "write_report",
]
