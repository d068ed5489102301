"""docloom: document analytics on PySpark (scans, extraction, diffs, forms, page sets, sinks)."""
