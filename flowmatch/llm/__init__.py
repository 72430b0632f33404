"""Training-data operators over a table of documents: near-duplicates, fingerprints,
quality, tokens, licences, personal data, shards and benchmark overlap.

Nothing outside this package imports it.
"""
