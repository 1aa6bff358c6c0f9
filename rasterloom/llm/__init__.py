"""Training-data operators: language ID, toxicity, LM scoring, BPE, near-duplicate join,
quality rules, sharding, packing, exact dedup and quality classification.

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
