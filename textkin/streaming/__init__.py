"""textkin.streaming"""
