"""Importing this module registers every query."""

from registry import carts, checks, dash, matching, texts, views  # noqa: F401
