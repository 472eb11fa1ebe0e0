"""Readers and writers; every reader has an explicit schema."""
