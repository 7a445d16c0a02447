"""DataFrame in, DataFrame out: joins, grouping, windows and annotation."""
