"""DataFrame rewrites behind SortedTable."""
