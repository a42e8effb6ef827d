"""Training-data operators: tokenisation, de-duplication, decontamination, scoring, sharding.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
