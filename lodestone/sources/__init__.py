"""lodestone sources"""
