"""Analytics over RL post-training data as Spark DataFrame jobs."""

__version__ = "0.1.0"
