"""Whole batch jobs: train and evaluate, predict and correlate."""
