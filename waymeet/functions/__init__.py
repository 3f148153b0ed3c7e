"""Column functions: angles, geometry, cameras and boxes."""
