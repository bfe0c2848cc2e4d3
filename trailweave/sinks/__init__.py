"""Writers: CSV, text grids, JSON, GeoJSON, maps, kernels."""
