"""Plan shapes that stay balanced when one key owns a large share of the rows."""
