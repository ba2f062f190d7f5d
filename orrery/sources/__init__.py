"""Readers and writers: poses, attribute sheets, OBJ, NPZ and PNG files, the scene graph."""
