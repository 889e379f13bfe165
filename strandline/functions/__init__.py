"""Column functions: names and urls, annotation types, descriptive text, JSON and command-line arguments."""
