"""Operations of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the registered queries.
"""
