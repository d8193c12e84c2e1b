"""SQL functions and dialect shims."""
