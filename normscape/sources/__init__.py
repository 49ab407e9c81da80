"""normscape.sources"""
