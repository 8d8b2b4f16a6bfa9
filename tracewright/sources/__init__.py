"""Lossless readers and block archives."""
