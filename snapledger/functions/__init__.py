"""Column functions: money in cents, dates, texts, hashes."""
