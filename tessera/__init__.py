"""Tessera: region triage and training-data analytics on Spark."""
