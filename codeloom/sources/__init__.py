"""Sources and sinks: source-tree scans, manifests, change feeds, table writers."""
