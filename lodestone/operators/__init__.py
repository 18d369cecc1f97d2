"""Operators over tables of detections, pieces and pixels."""
