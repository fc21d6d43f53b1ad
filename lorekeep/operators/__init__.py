"""Operators on memories, links, groups and vectors."""
