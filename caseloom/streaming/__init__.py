"""caseloom.streaming"""
