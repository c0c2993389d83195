"""Plans: the registered queries."""
