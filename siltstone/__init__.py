"""PySpark-native curation, auditing and scoring of instruction data sets."""
