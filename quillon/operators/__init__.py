"""Operators over tables of cases, candidates, events and scores."""
