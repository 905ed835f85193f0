"""Named queries over tables."""
