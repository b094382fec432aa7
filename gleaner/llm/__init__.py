"""Training-data operators: dedup, mixing, tokenising, chat formatting, quality and language."""
