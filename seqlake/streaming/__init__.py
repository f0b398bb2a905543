"""Searches whose queries arrive on a stream."""
