"""Readers and writers of event tables."""
