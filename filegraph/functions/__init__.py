"""Scalar language of manifests and transforms, JSON-Schema typing, row output."""
