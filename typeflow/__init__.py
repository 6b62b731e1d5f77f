"""Analytics over typing-activity logs, written as Spark DataFrame operators and streaming jobs."""

__version__ = "0.1.0"
