"""Column functions. All stay inside Spark's expressions; the few that need Python are in ``normalize``."""
