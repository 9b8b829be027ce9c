"""Reading and writing panels, predictions, fitted state and reports."""
