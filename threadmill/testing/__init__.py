"""Message tables derived from the given test tables, and the checked queries."""
