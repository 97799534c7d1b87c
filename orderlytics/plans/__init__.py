"""Named queries over the star-schema tables, and equivalent SQL for checking them."""
