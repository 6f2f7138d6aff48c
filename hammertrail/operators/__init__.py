"""hammertrail.operators"""
