"""Operators of a training-data pipeline: chat formatting, de-duplication, tokenization, quality,
personal data, toxicity, packing, HTML extraction and token files."""
