"""lodestone plans"""
