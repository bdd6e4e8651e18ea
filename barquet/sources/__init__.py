"""Reading, deriving and writing tables."""
