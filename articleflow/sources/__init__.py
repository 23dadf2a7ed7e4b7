"""Table, page and JSON-lines sources and sinks."""
