"""Part of the scene-map analytics engine."""
