"""Table-in, table-out operators over panels."""
