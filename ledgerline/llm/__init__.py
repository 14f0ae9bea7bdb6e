"""Operators for building large text corpora; nothing outside this package imports it."""
