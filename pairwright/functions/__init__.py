"""Column expressions and Arrow UDFs for comparing two records."""
