"""Matchers that ask a model about each pair: one call, or two agents and a judge."""
