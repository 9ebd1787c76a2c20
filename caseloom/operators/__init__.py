"""caseloom.operators"""
