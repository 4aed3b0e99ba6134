"""Column functions: sequences, labels and states, activity texts, keys and names."""
