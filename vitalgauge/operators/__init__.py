"""DataFrame to DataFrame operators, one module per report family."""
