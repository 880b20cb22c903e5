"""Training-data operators: PII, toxicity, quality, near-dedup, tool calls,
decontamination, pieces, substring dedup, language model, shards.

Nothing outside this folder imports it."""
