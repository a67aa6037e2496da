"""DataFrame → DataFrame operators; column names and rules are parameters."""
