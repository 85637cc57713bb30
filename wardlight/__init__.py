"""Message-risk analytics on Spark: score, monitor, moderate and curate tables or streams of messages."""

__version__ = "0.1.0"
