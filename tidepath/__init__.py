"""A PySpark engine for time-dependent routing over tables."""
