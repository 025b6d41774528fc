"""taskprep.operators"""
