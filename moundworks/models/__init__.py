"""Boosted and forest models over DataFrames, their registry, and what is scored with them."""
