"""normscape.operators"""
