"""taskprep.functions"""
