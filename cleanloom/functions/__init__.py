"""Column kernels and distributed statistics shared by the operators."""
