"""Column functions: formats, patterns, predicates and the text protocol."""
