"""Dictionaries, spelling, feature extractors, composition and models over DataFrames."""
