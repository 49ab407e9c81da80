"""normscape.plans"""
