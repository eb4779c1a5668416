"""Operators that prepare page texts, addresses and vectors for training language models.

They work on the library's own page records: a page is a row with the page key ``by`` (``doc_id,
page_no`` by default) and its ``text``. Nothing else in the library imports this folder.
"""
