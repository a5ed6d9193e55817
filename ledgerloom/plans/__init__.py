"""Block ranges and declarative queries over them."""
