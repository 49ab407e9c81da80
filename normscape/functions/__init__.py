"""normscape.functions"""
