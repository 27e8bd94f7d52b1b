"""Operators for preparing training text at scale, each with a general interface."""
