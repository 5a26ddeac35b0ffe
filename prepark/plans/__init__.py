"""Composed flows (the reference's entry points) and the query catalog."""
