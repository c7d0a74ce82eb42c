"""Corpusloom: document retrieval, text rules and log analytics on Spark."""
