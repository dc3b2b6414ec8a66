"""Public-opinion analytics as Spark jobs over tables of social-media posts."""

from .registry import TOOLS, execute
from .sources.posts import normalize_posts, read_posts

__all__ = ["TOOLS", "execute", "normalize_posts", "read_posts"]
