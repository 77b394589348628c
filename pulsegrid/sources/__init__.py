"""Readers and writers of recordings and masks."""
