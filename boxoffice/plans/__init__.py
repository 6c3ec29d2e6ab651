"""The registered queries, their DuckDB counterparts, and checks on physical plans."""
