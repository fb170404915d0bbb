"""Operations of a training-data pipeline: tokens, shards, filters, duplicates and packing."""
