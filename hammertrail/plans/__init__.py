"""hammertrail.plans"""
