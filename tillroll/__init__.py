"""tillroll: a Spark-native retail lakehouse.

Raw invoice lines are landed under a declared schema, screened (contract drift and
expectations), cleaned, layered into bronze / silver / gold, modelled as a star schema with
RFM segmentation, checked with quality rules and model tests, analysed, and their run
events and database logs are ingested with Structured Streaming.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL functions;
actions only happen at sinks and in the check runners.
"""

__version__ = "0.1.0"
