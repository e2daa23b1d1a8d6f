"""Training-data operators: deduplication, language ID, tokenising, search, scoring, mixing, scans.

Nothing outside this package imports it; deleting the folder leaves the rest of the library whole.
"""
