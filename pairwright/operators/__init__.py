"""Distributed operators over products, pairs, predictions and decisions."""
