"""Training-data operators: term statistics, tokenization, packing and splitting. Nothing outside imports this package."""
