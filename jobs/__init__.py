"""Jobs to run: each has a command line and a config file, and its work in a function that takes a session."""
