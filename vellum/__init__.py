"""Vellum: rule-based document and table analytics on Spark."""
