"""Structured Streaming forms of the review, the request limit and the comment check."""
