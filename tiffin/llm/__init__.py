"""Training-data operators: scoring, packing, deduplication, language and
quality models, tokenisation, vector search and personal data.

Each module holds one operator with a general interface; ``queries`` registers
one query per operator.  Nothing outside this package imports it.
"""
