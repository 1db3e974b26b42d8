"""A PySpark engine for industrial machine data."""
