"""Training-data operators (toxicity, fingerprints, BPE, WARC, mixing, quality, dedup, licences, edits, LM).

Nothing else in the library imports this subpackage.
"""
