"""textkin.sources"""
