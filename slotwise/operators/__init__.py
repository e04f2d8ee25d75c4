"""Index operators: dictionary, encodings, predicates, indexes, zone maps."""
