"""Operators that clean, score and pack a text corpus for training."""
