"""Column expressions and small Arrow kernels shared by the operators."""
