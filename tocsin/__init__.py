"""Incident analytics as Spark table jobs: messages in, incidents, forecasts and reports out."""
