"""Plans made of operators, and the query catalogue."""
