"""Operations on training data: counting, cleaning, scoring, deduplication, mixing and packing.

Nothing outside this subpackage imports it.
"""
