"""DataFrame-to-DataFrame operators: joins, scans, merges, aggregates."""
