"""Column functions: fixed tables, text matching, identifiers."""
