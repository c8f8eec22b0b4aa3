"""Training-data operators: extraction, dedup, decontamination, packing, scoring.

Nothing outside this subpackage imports it.
"""
