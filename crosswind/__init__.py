"""Factor research on Spark: panels, an expression compiler, analytics and statistics."""
