"""merchlens: retail and commerce analytics as Spark DataFrame jobs."""
