"""caseloom.functions"""
