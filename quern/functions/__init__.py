"""Column functions and the SQL functions built from the same expressions."""
