"""Readers and writers of inventories, grids and profiles."""
