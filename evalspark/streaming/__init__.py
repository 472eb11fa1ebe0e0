"""Continuous processing of new prompts."""
