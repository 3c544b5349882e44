"""Training-data operators: tokenising, scanning, deduplication, decontamination.

Nothing outside this subpackage imports it.
"""
