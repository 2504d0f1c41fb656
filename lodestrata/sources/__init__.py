"""lodestrata.sources"""
