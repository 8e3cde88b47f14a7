"""Graph views over the tables, and the registered queries."""
