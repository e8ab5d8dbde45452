"""Point clouds, labels and trees: where they come from and go to."""
