"""lodestrata.functions"""
