"""fieldmill: sparse adaptive field analytics as PySpark DataFrame jobs."""
