"""Training-data operators: packing, scans, near duplicates, extraction, classification.

Nothing else in the package imports this subpackage.
"""
