"""CSV exports, tables, query sets and metric state."""
