"""Column helpers (all built on JVM-side Spark functions)."""
