"""lodestone functions"""
