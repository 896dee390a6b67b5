"""Training-data operators: language, neighbours, tokens, contamination, scoring, privacy, urls, duplicates."""
