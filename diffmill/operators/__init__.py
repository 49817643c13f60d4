"""DataFrame-to-DataFrame operators of the review and the corpus job."""
