"""Column expressions: URL, HTML, Markdown and display helpers."""
