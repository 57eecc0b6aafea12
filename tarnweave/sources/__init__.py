"""Tables, wire formats and text lists."""
