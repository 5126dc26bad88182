"""Column functions: numerics with missing-value rules, ordered domains, text, distributions."""
