"""Record streams, verb chains and the expression language."""
