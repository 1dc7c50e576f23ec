"""Readers and writers of meshes and trees."""
