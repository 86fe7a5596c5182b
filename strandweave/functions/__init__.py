"""Column expressions: regions, CIGARs, DNA strings, SAM fields, SV events."""
