"""Sources and sinks: diffs, corpora, samples, webhook events, comments, products."""
