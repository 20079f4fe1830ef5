"""Jobs: queries that combine the operators over given tables."""
