"""Operations of a training-data pipeline: fingerprints, dedup, filters, packing, privacy, scoring.

Nothing else in the library imports this subpackage.
"""
