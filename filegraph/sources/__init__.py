"""Readers of registered sources, and their profiles."""
