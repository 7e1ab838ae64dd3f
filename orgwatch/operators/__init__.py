"""DataFrame operators: predicates, projections, joins, statistics, top-k, deduplication, writes, merges."""
