"""Plan assembly: sources, operators and functions composed into queries."""
