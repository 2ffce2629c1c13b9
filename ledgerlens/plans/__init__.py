"""End-to-end layer flows and the query catalogue."""
