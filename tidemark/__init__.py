"""tidemark: notice analytics and training-data operators expressed as Spark jobs."""
