"""Agent-experience analytics as ordinary Spark plans."""
