"""Readers and writers of document collections and index tables."""
