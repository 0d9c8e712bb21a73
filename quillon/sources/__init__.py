"""Readers and writers of ledgers, traces, atlases, arrays and synthetic images."""
