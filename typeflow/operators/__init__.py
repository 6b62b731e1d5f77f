"""DataFrame operators: each takes a typing or key event table and returns a DataFrame."""
