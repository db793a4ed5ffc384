"""Training-data operators: deduplication, filtering, extraction, mixing and fixity.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers them over the driver tables.
"""
