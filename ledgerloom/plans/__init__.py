"""Plans over ledger tables: storage between steps, the query compiler, and the projection of a star schema."""
