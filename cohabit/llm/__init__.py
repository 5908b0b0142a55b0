"""Training-data operators: ten Spark jobs for text corpora.

Each module holds one operator with a general interface; ``queries`` holds the
thin contract queries and their SQL.  Nothing outside this subpackage imports it.
"""
