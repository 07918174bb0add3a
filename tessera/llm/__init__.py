"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface; ``registry`` maps the ``opN_<name>``
queries onto them.
"""
