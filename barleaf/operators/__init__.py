"""Table operators over the (ticker, date) panel. Rows are flagged, never dropped."""
