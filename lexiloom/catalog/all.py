"""Importing this module registers every query."""

from lexiloom.catalog import corpus, replies, traffic, urls  # noqa: F401
