"""Readers and writers of notes, registries and ledgers."""
