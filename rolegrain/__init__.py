"""Posting analytics on Spark: DataFrame operators over job-posting corpora."""
