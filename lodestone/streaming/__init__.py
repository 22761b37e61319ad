"""lodestone streaming"""
