"""Where ledger tables come from."""
