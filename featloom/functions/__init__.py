"""Column builders: scalar, row-wise and metric expressions."""
