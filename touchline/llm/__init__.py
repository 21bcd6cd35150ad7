"""Training-data operators for sequences and texts; nothing else in the library imports this."""
