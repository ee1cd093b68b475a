"""DataFrame to DataFrame operators: joins, groupings, windows, merges."""
