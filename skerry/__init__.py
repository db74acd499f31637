"""Skerry: search and analytics over JSON documents on PySpark."""
