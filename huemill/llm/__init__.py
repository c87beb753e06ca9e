"""Operators for training-data pipelines: token counts, deduplication, sharding, decontamination,
personal data, packing, language-model scores, quality rules and similarity joins over documents.

Nothing else in the library imports this subpackage.
"""
