"""Training-data operators: scans, deduplication, classifiers, encodings, archives, packing.

Nothing outside this subpackage imports it.
"""
