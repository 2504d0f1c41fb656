"""lodestrata.streaming"""
