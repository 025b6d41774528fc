"""taskprep.streaming"""
