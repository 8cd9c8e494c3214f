"""Training-data operators: filtering, deduplication, search and mixing for text corpora.

Nothing outside this subpackage imports it; ``registry`` holds its queries and their SQL.
"""
