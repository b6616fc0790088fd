"""Column functions of the text kernel."""
