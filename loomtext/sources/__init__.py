"""Readers and writers of texts, features and models."""
