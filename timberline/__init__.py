"""Timberline: longitudinal, competing-risk analytics as composable Spark DataFrame operators."""
