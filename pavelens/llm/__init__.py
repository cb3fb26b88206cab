"""Text, vector and URL operators for building training corpora from survey records.

Nothing outside this folder imports it; ``queries`` registers the ``opN_`` queries.
"""
