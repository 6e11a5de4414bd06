"""Column expressions (JVM-side) and small closed-form helpers."""
