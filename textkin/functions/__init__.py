"""textkin.functions"""
