"""Operators for preparing training corpora (documents, pages, benchmark tables).

Nothing outside this package imports it; ``queries`` registers its queries.
"""
