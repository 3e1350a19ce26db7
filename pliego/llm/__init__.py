"""Operators for building training corpora: search, packing, tokenizers, deduplication, classifiers, licences, WARC."""
