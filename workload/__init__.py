"""Driver bindings: log views derived from the test tables, queries, and their SQL."""
