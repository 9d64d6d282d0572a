"""Column expressions: text, coercion, vectors, markup, payloads."""
