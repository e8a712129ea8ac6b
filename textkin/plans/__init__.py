"""textkin.plans"""
