"""lodestrata.operators"""
