"""tesserae: a PySpark-native engine for searchable 3D object maps and large-scale analytics."""
