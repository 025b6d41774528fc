"""taskprep.plans"""
