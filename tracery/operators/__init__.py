"""DataFrame operators over entity series."""
