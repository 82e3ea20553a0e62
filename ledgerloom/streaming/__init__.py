"""Structured Streaming: block and transaction feeds, live queries and expiry."""
