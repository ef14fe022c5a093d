"""DataFrame operators on inventories, rasters and detections."""
