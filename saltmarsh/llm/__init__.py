"""Operators for preparing training corpora; see the module of each for its contract."""
