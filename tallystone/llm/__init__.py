"""Training-data operators: tokenisation, filtering, deduplication and screening of text corpora."""
