"""Operators for preparing training corpora; nothing else in tidewake imports this subpackage."""
