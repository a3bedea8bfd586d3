"""Document retrieval and corpus quality as Spark jobs."""
