"""Document extraction, term mining and text analytics as Spark jobs."""
