"""Column builders: every scalar rule of the engine as an expression of built-in functions."""
