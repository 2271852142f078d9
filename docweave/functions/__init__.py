"""Column functions: text, URLs, paths, hashes and times. All are built-in expressions, so they stay in generated code."""
