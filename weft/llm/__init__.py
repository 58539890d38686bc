"""Operations of a training-data pipeline over documents and web pages.

Nothing else in the package imports this subpackage; it may be removed as a whole.
"""
