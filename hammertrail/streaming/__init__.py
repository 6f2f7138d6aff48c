"""hammertrail.streaming"""
