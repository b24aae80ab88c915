"""Readers and writers: products, pairs, candidates, decision caches, timings."""
