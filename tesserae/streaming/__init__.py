"""tesserae.streaming"""
