"""Training-data operators: mixing, dedup, filters, scoring and extraction over corpora."""
