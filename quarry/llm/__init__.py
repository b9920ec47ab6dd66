"""Training-data operators: packing, deduplication, decontamination, language
identification, sharding, URL filters and token counts.

Nothing else in the library imports this subpackage.
"""
