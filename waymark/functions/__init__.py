"""Part of the waymark engine."""
