"""Query plans that combine operators, and the registry of queries."""
