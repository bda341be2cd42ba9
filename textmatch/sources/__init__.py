"""Text, HTML, JSON and base64 contents to dictionaries."""
