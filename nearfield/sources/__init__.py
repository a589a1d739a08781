"""Vector file formats and versioned stores."""
