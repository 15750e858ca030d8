"""The stateless scoring plan on streams of files."""
