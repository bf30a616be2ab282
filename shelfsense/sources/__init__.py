"""Readers, writers and the adapters from the order tables to shop tables."""
