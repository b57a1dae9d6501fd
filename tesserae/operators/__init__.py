"""tesserae.operators"""
