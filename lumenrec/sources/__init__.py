"""Readers, writers and the paged data source."""
