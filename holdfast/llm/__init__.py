"""Training-data operators: deduplication, quality, language, packing, privacy.

Nothing outside this subpackage imports it; ``queries`` registers its ``opN_<name>`` queries.
"""
