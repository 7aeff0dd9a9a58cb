"""Training-data operators: sharding, dedup, language ID, PII, WARC, search, mixing, tokens, scoring, near duplicates."""
