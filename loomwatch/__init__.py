"""Security-event analytics and corpus preparation as Spark jobs."""
