"""Complete jobs: the review job and the corpus job."""
