"""Stylometric text analytics on Spark: corpora to style profiles, drafts scored against them."""
