"""Reading raw corpora and writing results."""
