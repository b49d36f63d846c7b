"""Where meshes come from and go to."""
