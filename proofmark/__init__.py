"""Proofmark: label-record verification and corpus preparation as Spark jobs."""
