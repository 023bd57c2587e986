"""Readers that bring inputs into the long ``samples`` form, and writers of results."""
