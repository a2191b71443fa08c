"""Column expressions and Arrow functions for text, Unicode and similarity."""
