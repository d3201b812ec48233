"""Operators of a training-data pipeline: mixing, near and substring duplicates,
quality, decontamination, toxicity, language, page extraction, chat pairs, token files."""
