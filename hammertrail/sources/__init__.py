"""hammertrail.sources"""
