"""Training-data operators: tokenised output, packing, scrubbing, filtering and near-duplicate search."""
