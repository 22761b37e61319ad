"""lodestone operators"""
