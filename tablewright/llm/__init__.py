"""Operators that prepare text corpora for training: duplicates, quality, toxicity, extraction, mixing, counts, licences."""
