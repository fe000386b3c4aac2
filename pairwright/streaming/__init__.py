"""Streaming forms of the pair operators (see ``balance``)."""
