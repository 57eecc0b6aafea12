"""Jobs made of operators, and the queries by name."""
