"""Operations for preparing large training corpora, each by one named method.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
