"""Relational operators and kernels over the engine's tables."""
