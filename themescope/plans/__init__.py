"""End-to-end plans: the registered queries and their SQL oracles."""
