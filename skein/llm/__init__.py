"""Training-data operators: ten batch stages for corpora of documents, pages and vectors.

Nothing outside this subpackage imports it; `queries` binds the operators to the driver's tables.
"""
