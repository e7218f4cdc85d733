"""Operators for preparing large text and motion corpora; nothing else imports this package."""
