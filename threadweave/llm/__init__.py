"""Training-corpus operators: quality, deduplication, tokens, packing, extraction, archives.

Each takes the library's own records (posts with ``tweet_id`` and ``text``, links found in
posts) or, where posts hold nothing of the kind, plain tables, and returns a DataFrame.
Nothing outside this package imports it.
"""
