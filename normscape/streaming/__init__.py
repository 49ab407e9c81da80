"""normscape.streaming"""
