"""Column expressions: catalog schemas, typed statistics, predicates and texts."""
