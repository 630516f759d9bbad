"""Column builders: text, parsing, gates and scores."""
