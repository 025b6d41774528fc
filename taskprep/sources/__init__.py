"""taskprep.sources"""
