"""DataFrame operators: matching, joins, windows, aggregates, keyed state."""
