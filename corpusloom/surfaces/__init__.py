"""What people and programs talk to: a Python service, a command line, and a local web server."""
