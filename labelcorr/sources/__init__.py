"""Reading and writing posts, predictions, folds and models."""
