"""tesserae: evidence, usage and training-data operators for PySpark."""
