"""Readers and writers of the contract tables."""
