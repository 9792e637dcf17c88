"""Operators for preparing training text: scoring, fingerprints, deduplication, decontamination, sharding, quality,
personal data, mixing and language identification. Nothing else in the library imports this package."""
