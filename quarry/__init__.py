"""A PySpark analytics library."""
