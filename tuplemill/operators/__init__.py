"""Operators over tuples: storage, links, queries, JSON documents, rules."""
