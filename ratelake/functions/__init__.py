"""Column expressions over ratings, scores and paths; all JVM-side."""
