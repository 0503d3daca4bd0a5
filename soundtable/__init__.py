"""soundtable: audio sessions, spatial scenes and deliverables as Spark tables."""
