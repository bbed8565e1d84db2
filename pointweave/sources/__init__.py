"""Files and messages to tables and back."""
