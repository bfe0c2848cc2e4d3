"""DataFrame operators over tracks, grids, weather and walks."""
