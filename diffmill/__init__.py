"""diffmill: code-review analytics over tables and streams of unified diffs."""

__version__ = "0.1.0"
