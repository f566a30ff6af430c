"""The operators, one module per area."""
