"""Where index tables and intermediate tables live."""
