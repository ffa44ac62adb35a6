"""Whole pipelines: the settlement cases and the jobs that write them."""
