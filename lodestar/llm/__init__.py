"""Training-data operators: ten distributed text and vector operators.

Nothing outside this subpackage imports it; ``queries.py`` holds its query registry.
"""
