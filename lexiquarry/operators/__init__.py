"""Relational building blocks: index build, retrieval, classification, skew-safe aggregation."""
