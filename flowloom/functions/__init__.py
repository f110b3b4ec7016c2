"""Functions of the code-flow graph engine."""
