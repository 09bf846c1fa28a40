"""Column expressions: sky geometry, names and headers, dispersion. None shuffles."""
