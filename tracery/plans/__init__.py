"""Views of the given tables as entity series, and the registered queries."""
