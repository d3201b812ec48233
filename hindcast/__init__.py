"""Point-in-time event research as Spark jobs."""

__version__ = "0.1.0"
