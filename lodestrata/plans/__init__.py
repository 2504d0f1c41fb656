"""lodestrata.plans"""
