"""Operations of a training-data pipeline: search, deduplication, scoring, scanning, tokenizing and packing."""
