"""The bucket operator on streams."""
