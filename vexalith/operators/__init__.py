"""DataFrame operators: projection, order, groups, joins, similarity search, accuracy."""
