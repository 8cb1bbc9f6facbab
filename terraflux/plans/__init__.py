"""From filter texts and query options to DataFrame plans."""
