"""DataFrame operators: joins, aggregations, windows, ordering."""
