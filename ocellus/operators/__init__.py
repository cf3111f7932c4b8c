"""Relational operators over model outputs, and numpy kernels for pixels."""
