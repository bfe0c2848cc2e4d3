"""Readers: tracks, terrain, weather, walks, and the fixtures derived from the driver tables."""
