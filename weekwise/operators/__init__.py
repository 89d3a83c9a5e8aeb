"""DataFrame operators: cleaning, calendars, joins, aggregation, windows, scores, statistics, audits."""
