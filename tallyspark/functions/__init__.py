"""Column functions: each takes and returns columns and keeps no state."""
