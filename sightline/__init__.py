"""Spark-first engine for evidence about photo and video collections."""
