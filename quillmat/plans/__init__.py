"""Lazy pipelines: jobs, projection onto new data, and the algebra of symbolic matrices."""
