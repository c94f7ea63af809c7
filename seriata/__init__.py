"""seriata: Spark-first analytics for ordered stacks of sections, tiles and features."""
