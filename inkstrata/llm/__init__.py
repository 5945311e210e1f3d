"""Training-data operators: classifiers, tokenising, search, de-duplication, mixing.

Nothing outside this subpackage imports it.
"""
