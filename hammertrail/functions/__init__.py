"""hammertrail.functions"""
