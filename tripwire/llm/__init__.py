"""Operators of a large-scale training-data pipeline (text, tokens, embeddings, mixing)."""
