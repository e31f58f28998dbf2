"""Training-data operators: language id, formatting, tokens, search, filters, near duplicates.

Nothing outside this subpackage imports it.  ``flowmill.llm.queries`` registers its queries.
"""
