"""Operators over node and edge tables."""
