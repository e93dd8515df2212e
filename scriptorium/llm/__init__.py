"""Training-data operators: packing, mixing, quality, fingerprints, chat, language, tokens, HTML, near-dedup, PII, exact dedup, search, whitening."""
