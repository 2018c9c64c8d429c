"""Types, expressions and scalar functions of the language."""
