"""Readers and writers of this domain's files."""
