"""Column expressions and numpy kernels: metrics, label predicates, quantizers."""
