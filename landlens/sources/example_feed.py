"""Smallest source for the custom feed: one row an account."""


def fetch(account: str):
    return [{"text": f"hello from {account}", "iso": "", "url": ""}]
