"""Relational operators over views, rankings, routes and point sets."""
