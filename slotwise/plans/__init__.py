"""Query catalogue over the standard tables."""
