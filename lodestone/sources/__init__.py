"""Readers and writers of the item library, images and recognizer output."""
