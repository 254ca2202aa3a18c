"""Column expressions: no state, no Python in the executors."""
