"""Training-data operators: near-dedup, extraction, decontamination, tokenizing, rendering, filters, archives.

Nothing outside this subpackage imports it. Each module holds one operator
with its general interface; ``queries`` holds the thin contract queries.
"""
