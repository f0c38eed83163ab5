"""Operators for cleaning and preparing text corpora for language-model training."""
