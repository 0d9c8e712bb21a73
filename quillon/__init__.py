"""Evaluation and audit of detection-and-decision pipelines on Spark."""
