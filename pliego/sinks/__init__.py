"""Where results go: tables, JSON artifacts in chunks, CSV, reports."""
