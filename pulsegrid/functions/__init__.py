"""Column expressions: text, arrays, spectra."""
