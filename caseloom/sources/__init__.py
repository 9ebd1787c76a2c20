"""caseloom.sources"""
