"""DataFrame operators on cells."""
