"""Readers and writers. All go through Spark, so any file system that Spark knows will do."""
