"""Column builders and small DataFrame helpers shared by the operators."""
