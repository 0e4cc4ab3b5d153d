"""Column builders: predicates, aggregates, distances."""
