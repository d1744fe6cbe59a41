"""Audience-reaction analytics as composable Spark DataFrame operators."""
