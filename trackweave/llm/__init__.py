"""Training-data operators: dedup, decontamination, licences, quality, archives, tokens, HTML.

Nothing outside this subpackage imports it.
"""
