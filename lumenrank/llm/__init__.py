"""Training-data operators: toxicity, deduplication, licences, decontamination, mixing, sharding, tokens.

Nothing outside this subpackage imports it.
"""
