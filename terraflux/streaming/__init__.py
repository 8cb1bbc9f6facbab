"""Latest-value views over change streams."""
