"""docloom.functions."""
