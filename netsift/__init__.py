"""Network-security analytics on Spark DataFrames.

``functions``  column expressions (addresses, indicators, alert texts, plates)
``sources``    readers and writers for packets, feeds, logs, images
``operators``  DataFrame -> DataFrame operators, batch
``streaming``  the same work on Structured Streaming
``plans``      the query catalogue on the driver's tables
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
