"""textkin.operators"""
