"""caseloom.llm"""
