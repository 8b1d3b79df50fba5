"""Column functions: expressions without shuffles or actions."""
