"""veilmark: a Spark-native engine for page perception, redaction and egress audit tables."""

__version__ = "0.1.0"
