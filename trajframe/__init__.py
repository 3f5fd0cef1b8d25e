"""trajframe: paired-scenario analytics as PySpark DataFrame jobs."""
