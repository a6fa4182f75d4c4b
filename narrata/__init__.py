"""Spark-native preparation and analysis of long-form text for narration."""
