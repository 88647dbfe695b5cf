"""Column functions over sequences and the table of triplet parameters."""
